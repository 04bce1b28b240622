"""Quality, personal data, language and toxicity, and the pipeline."""

import hashlib
import math
import random
import time
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from cases import AWKWARD
from kinosift.llm import content_sort, language, order_minhash, pii, quality, toxicity

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    held = {w: windows.count(w) for w in set(windows)}
    repeated = {i + k for i, w in enumerate(windows) if held[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, table):
    draw = random.Random(1)
    rows = AWKWARD + [(100 + i, "".join(draw.choice(["a ", "b ", "c\n", "#| ", "é\t", "the of and to in a b c "]) for _ in range(draw.randint(0, 80)))) for i in range(60)]
    found = quality.scored(table(rows)).collect()
    want = []
    for doc, text in rows:
        n, chars, symbols, dup, repeated = plain_counts(text)
        want.append((doc, n, chars, symbols, dup, repeated, n < 20 or 100 * repeated > 30 * n))
    assert sorted(str(tuple(r)[:7]) for r in found) == sorted(map(str, want))
    assert quality.scored(table([])).count() == 0
    kept = sorted(str(r.doc_id) for r in found if r.kept)
    left = quality.filtered(table(rows))
    assert sorted(str(r.doc_id) for r in left.collect()) == kept and left.columns == table([]).columns


@pytest.mark.parametrize("name", ["op9_quality_rules", "op5_exact_dedup"])
def test_queries_equal_sql(spark, name):
    from kinosift.llm import queries

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.QUERIES[name](spark, SF)
    result = connection.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(str([r[n] for n in names]) for r in found.collect()) == sorted(str(list(r)) for r in result.fetchall())


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choice("12345601.. -@@+ab()é%_\n") for _ in range(draw.randint(1, 60)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE_KINDS] == plain_spans(text)


def test_long_runs_take_no_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 50_000, "+" * 100_000, "1 " * 50_000):
        pii.find(text)


def test_many_spans_take_linear_time():
    """Twice the spans take about twice the time: a quadratic search took 4 times as long, and 6.5 s for the larger text."""
    taken = []
    for n in (8_000, 16_000):
        text = "ssn 123-45-6789 call +1 555 123 4567 " * n
        began = time.process_time()
        found = pii.find(text)
        taken.append(time.process_time() - began)
        assert len(found) == 2 * n
    assert taken[1] < 3 * taken[0] + 0.5
    assert pii.mask("a@b.cc " * 30_000).count("[EMAIL]") == 30_000


def plain_find(text):
    """Each extra span against all that are taken."""
    spans = [(s.kind, s.start, s.end, pii._score(text, s)) for s in pii._base(text)]
    for kind in pii._more(text):
        for extra in kind:
            score = pii._score(text, extra)
            if score >= pii.THRESHOLD and all(extra.end <= s[1] or s[2] <= extra.start for s in spans):
                spans.append((extra.kind, extra.start, extra.end, score))
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_overlaps_equal_a_loop():
    draw = random.Random(8)
    pieces = ["ssn ", "123-45-6789", " ", "call ", "(555) 123-4567", "+1 555 123 4567", "4111 1111 1111 1111", "DE89370400440532013000", "a@b.cc", "1.2.3.4", "-", ".", "x"]
    for _ in range(400):
        text = "".join(draw.choices(pieces, k=draw.randint(1, 12)))
        assert pii.find(text) == plain_find(text), text


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [s[0] for s in pii.find("iban GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert [s[0] for s in pii.find("ssn 123-45-6789")] == ["national_id"] and not pii.find("part 123-45-6789")
    assert pii.mask("mail a@b.co or 4111 1111 1111 1111.") == "mail [EMAIL] or [CARD]."


def test_ibans_end_at_their_length():
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for after in ("", ".", " EUR 500", " 2024", " BIC COBADEFF", " and", " 1 2 3 4 5 6 7 8 9"):
            assert [s[:3] for s in pii.find(f"to {iban}{after}") if s[0] == "iban"] == [("iban", 3, 3 + len(iban))], (iban, after)
        assert pii.mask(f"to {iban} EUR 500") == "to [IBAN] EUR 500"
        assert pii.mask(f"{iban} {iban}") == "[IBAN] [IBAN]"
        assert pii.mask(f"REF {iban}") == "REF [IBAN]" and pii.mask(f"AB12 {iban}") == "AB12 [IBAN]"
        assert not [s for s in pii.find(iban + "7") + pii.find("X" + iban) if s[0] == "iban"]
    # A country without a known length: the end that the check digits confirm.
    other = "ZZ" + next(f"{c:02}" for c in range(2, 99) if pii.mod97(f"ZZ{c:02}12345678901234")) + "12345678901234"
    assert ("iban", 0, len(other)) in [s[:3] for s in pii.find(other)] and pii.mask(other + " EUR").startswith("[IBAN]")
    pii.find("AB12 " * 50_000)


def test_span_digests(spark, table):
    rows = AWKWARD + [(20, "é a@b.co 10.0.0.1")]
    found = {str((r.doc_id, r.spans)): r for r in pii.digest(pii.spans_of(table(rows))).collect()}
    row = found[str((20, "email:2:8,ip:9:17"))]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 0)
    assert row.base_sha256 == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    masked = pii.masked(table(rows)).collect()
    assert [(r.doc_id, r.text) for r in masked] == [(d, "é [EMAIL] [IP]" if d == 20 else t) for d, t in rows]
    assert pii.spans_of(table([])).count() == 0


def plain_viterbi(scores, switch):
    value, back = list(scores[0]), []
    for row in scores[1:]:
        step = [max(range(len(row)), key=lambda k, j=j: value[k] - (k != j) * switch) for j in range(len(row))]
        back.append(step)
        value = [value[k] - (k != j) * switch + row[j] for j, k in enumerate(step)]
    return max(value), back


@pytest.mark.parametrize("seed", range(10))
def test_viterbi_equals_a_loop(seed):
    draw = np.random.default_rng(seed)
    scores = draw.normal(size=(30, 3)).astype(np.float32)
    lengths = np.array([0, 5, 17, 1, 0, 9])
    states = draw.integers(0, 30, lengths.sum())
    labels = language.viterbi(lengths, states, scores, 1.5)
    at = 0
    for n in lengths:
        own, rows = labels[at : at + n], scores[states[at : at + n]]
        at += n
        if n:
            got = sum(rows[i, k] for i, k in enumerate(own)) - 1.5 * (own[1:] != own[:-1]).sum()
            assert got == pytest.approx(plain_viterbi(rows.astype(float).tolist(), 1.5)[0], abs=1e-4)


def labelled(spark):
    rows = [(i, f"the cat and the dog with house number {i} thing", "en") for i in range(60)] + [(100 + i, f"der hund und die katze mit haus nummer {i} ding", "de") for i in range(60)] + [(200 + i, "кот и собака в доме", "ru") for i in range(60)]
    return spark.createDataFrame([*rows, (300, None, "en"), (301, "x", None)], "doc_id long, text string, lang string")


def test_languages_and_spans(spark, table):
    model = language.train(labelled(spark))
    assert model.languages == ["de", "en", "ru"]
    rows = AWKWARD + [(20, "der hund und die katze und das haus mit der nummer. the dog and the cat with the thing in the house"), (21, "собака"), (22, "日本"), (23, "123 !")]
    found = {str((r.doc_id, t)): r for r, (d, t) in zip(language.detected(table(rows), model, spans=True).collect(), rows)}
    assert [s.lang for s in found[str((20, rows[10][1]))].spans] == ["de", "en"]
    assert found[str((21, "собака"))].lang_pred == "ru"
    assert found[str((23, "123 !"))].lang_pred == found[str((2, None))].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = language.train(labelled(spark).limit(0))
    assert {r.lang_pred for r in language.detected(table(AWKWARD), nothing).collect()} == {"und"}
    assert language.detected(table([]), model).count() == 0


def test_numbers_are_no_letters_and_long_runs_are_cut(spark, table):
    model = language.train(labelled(spark))
    long = "кот" * 200_000
    rows = [(1, "½ ² Ⅷ ①"), (2, long), (3, "the dog and the cat ½"), (3, "the dog and the cat ½")]
    found = [(r.lang_pred, r.score) for r in language.detected(table(rows), model).collect()]
    assert found[0] == ("und", 0.0) and found[1] == ("ru", 1.0) and found[2] == found[3] and found[2][0] == "en"
    assert max(map(len, language._WORDS.findall(long))) == language.LONGEST


def test_faster_words_equal_the_pattern():
    draw = random.Random(12)
    for _ in range(2000):
        text = "".join(draw.choice(["ab", "é", "½", "²", "7", "_", " ", "x" * 70, "кот", "日本", "Ⅷ"]) for _ in range(draw.randint(0, 8)))
        assert language.words_of(text) == language._WORDS.findall(text), text


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.train(labelled(spark))


def test_language_counts_equal_a_loop(spark):
    model = language.train(labelled(spark))
    counts = {}
    for row in labelled(spark).collect():
        if row.lang and row.text:
            for word in re.findall(r"[^\W\d_]+", row.text.lower()):
                raw = f" {word} ".encode()
                for n in (2, 3, 4):
                    for i in range(len(raw) - n + 1):
                        key = (row.lang, zlib.crc32(raw[i : i + n]) % language.BUCKETS)
                        counts[key] = counts.get(key, 0) + 1
    for at, lang in enumerate(model.languages):
        total = sum(n for (x, _), n in counts.items() if x == lang)
        want = np.full(language.BUCKETS, 0.5)
        for (x, bucket), n in counts.items():
            if x == lang:
                want[bucket] += n
        assert np.allclose(model.log_p[at], np.log(want / (total + 0.5 * language.BUCKETS)), atol=1e-5)


def test_held_out_languages(spark):
    from kinosift.llm import queries

    truth = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    found = queries.op3_language_id(spark, SF).toPandas()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]).all()
    out = found[found.held_out]
    assert (out.lang_pred.to_numpy() == truth.loc[out.doc_id, "lang"].to_numpy()).mean() > 0.95


def test_held_out_toxicity(spark, table):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    texts = [(i, " ".join([*draw.choices(words, k=60), *(["nastyword"] if i % 4 == 0 else [])])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300)] + [(None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(table(texts), labels)
    found = {r.doc_id: r for r in toxicity.scored(table(texts), model).collect()}
    assert all(found[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    rows = toxicity.scored(table(AWKWARD), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(table([]), model).count() == 0
    none = toxicity.train(table(texts), labels.limit(0))
    assert toxicity.scored(table([(1, "a")]), none).first()["score"] == 0.5


def plain_features(text):
    """Distinct words of a text that hold each n-gram."""
    words = set(text.lower().split())
    counts = {}
    for word in words:
        raw = f" {word} ".encode()
        for gram in {zlib.crc32(raw[i : i + n]) % toxicity.BUCKETS for n in toxicity.SIZES for i in range(len(raw) - n + 1)}:
            counts[gram] = counts.get(gram, 0) + 1
    return counts


def test_toxicity_equals_loops(spark, table):
    """Ratios, the fit's optimum and the scores, each by plain loops over the same rows."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(draw.choices(words, k=draw.randint(1, 20)) + ["bad"] * (i % 3 == 0 and draw.random() < 0.8))) for i in range(60)]
    labels = {i: int(i % 3 == 0) for i, _ in texts}
    model = toxicity.train(table(texts), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    rows = {i: plain_features(t) for i, t in texts}
    kinds = [sum(1 for v in labels.values() if v == k) for k in (0, 1)]
    held = [{}, {}]
    for i, found in rows.items():
        for gram in found:
            held[labels[i]][gram] = held[labels[i]].get(gram, 0) + 1
    ratio = {g: math.log(((held[1].get(g, 0) + 1) / (kinds[1] + 2)) / ((held[0].get(g, 0) + 1) / (kinds[0] + 2))) for g in held[0].keys() | held[1].keys()}
    unseen = np.ones(toxicity.BUCKETS, dtype=bool)
    unseen[list(ratio)] = False
    assert not model.weight[unseen].any()
    plain = lambda i: 1 / (1 + math.exp(-model.bias - sum(model.weight[g] * x for g, x in rows[i].items())))
    errors = {i: plain(i) - labels[i] for i in rows}
    assert abs(sum(errors.values()) / len(rows)) < 1e-3
    for g, r in ratio.items():  # the slope of the ridge-penalised loss is nought at the optimum
        own = model.weight[g] / r if r else 0.0
        assert abs(sum(errors[i] * found.get(g, 0.0) * r for i, found in rows.items()) + toxicity.RIDGE * own) / len(rows) < 2e-3
    found = {r.doc_id: r.score for r in toxicity.scored(table(texts), model).collect()}
    assert all(found[i] == pytest.approx(plain(i), abs=1e-4) for i in rows)


def test_toxicity_of_the_standard_documents(spark):
    from kinosift.llm import queries

    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").dropna(subset=["toxic"]).set_index("doc_id")
    found = queries.op7_toxicity(spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    out = found[found.held_out & found.index.isin(labels.index)]
    truth = labels.loc[out.index, "toxic"]
    assert len(out) > 500 and (out.predicted.to_numpy() == truth.to_numpy()).mean() > 0.95


def test_awkward_texts_have_scores(spark, table):
    rows = [*AWKWARD, (20, "bad" * 300_000), (21, "bad word " * 50_000), (22, "WORD1 word1"), (22, "WORD1 word1")]
    model = toxicity.train(table([(i, "word1 word2" if i % 2 else "bad") for i in range(20)]), spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id long, toxic int"))
    found = toxicity.scored(table(rows), model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found) and found[-1].score == found[-2].score
    assert {r.doc_id: r.predicted for r in found}[21] == 1


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.scored(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    texts = {d: t for d, t in zip(docs.doc_id.tolist(), docs.text) if d in kept}
    first = {}
    for doc in sorted(texts):
        first.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), texts[doc]), doc)
    texts = {d: texts[d] for d in sorted(first.values())}
    shingles = {d: order_minhash.labelled_shingles(order_minhash.word_hashes(t)[0]) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in texts:
        for b in texts:
            if b < a and order_minhash.similarity(shingles[a], shingles[b]) >= 0.8:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    texts = {d: pii.mask(t) for d, t in texts.items() if root(d) == d}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert found.groupby("doc_id").length.sum().to_dict() == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    ends = found.sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id").length.cumsum() - ends.length == ends.offset).all() and found.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_return_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_stages_take_awkward_rows(spark, table, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names, through every stage and through the run."""
    import corpus_pipeline

    draw = random.Random(2)
    good = lambda: " ".join(draw.choice(["the", "cat", "and", "a", "house", "of", f"w{draw.randint(0, 999)}"]) for _ in range(80))
    long, twice = " ".join(f"the w{i}" for i in range(30_000)), good()
    near = twice.split()
    near[40] = "changed"
    rows = [*AWKWARD, (30, long), (31, twice), (31, twice), (None, twice.upper()), (32, " ".join(near)), (None, good()), (33, good() + " mail me@there.org"), (33, good())]
    docs = table(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        assert after.count() <= len(rows), name
    assert corpus_pipeline.pack(spark, docs, "").agg({"doc_id": "max"}).first()[0] == 33
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of the three rows with the text and its near copy one is left, of the two rows 33 both, and the long one is cut.
    assert sorted(str(r.doc_id) for r in found if r.piece == 0) == ["30", "31", "33", "33", "None"]
    assert sum(r.length for r in found if r.doc_id == 30) > 2048
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(content_sort.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "kinosift.llm" not in path.read_text(), path
