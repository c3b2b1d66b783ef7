"""Substring and near deduplication, decontamination and token counts against brute force on small tables with odd rows."""

import hashlib
import random
import re

import pytest

from meterline.llm import decontaminate, near_dedup, substring_dedup, token_count

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, seed long, node string"


def corpus(seed=3):
    """Random texts with copies, near copies, shared passages, and odd rows; `seed` and `node` clash with inner names."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "Üb", "A", "a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows = text(60), []
    for i in range(60):
        rows.append(text(rng.randrange(1, 150)))
    rows += [rows[3], rows[3], rows[7].upper(), passage, text(30) + " " + passage + "\n\t" + text(30), passage + " " + text(10), text(5) + " " + passage]
    for _ in range(12):
        near = rows[10].split()
        for _ in range(2):
            near[rng.randrange(len(near))] = "changed"
        rows.append(" ".join(near))
    rows += ["", None, "   \n", "one", "two words", "same " * 300, text(3000) + " " + passage, "x" * 5000, "a\x00b c"]
    rng.shuffle(rows)
    return [(i * 2 + 1, x, 5, "n") for i, x in enumerate(rows)]


def brute_repeats(rows, window):
    words = {i: SPACE.findall(x or "") for i, x, *_ in rows}
    seen, out = set(), {}
    for i in sorted(words):
        gone = set()
        for s in range(len(words[i]) - window + 1):
            key = tuple(words[i][s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [w for j, w in enumerate(words[i]) if j not in gone]
        out[i] = (len(words[i]), len(gone), " ".join(kept))
    return out


@pytest.mark.parametrize("window,seed", [(20, 6), (5, 5), (8, 1)])
def test_substring_repeats_equal_brute_force(spark, window, seed):
    rows = corpus()
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, DDL).repartition(3), window=window, seed=seed).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == brute_repeats(rows, window)


def test_substring_odd_rows(spark):
    text = " ".join(str(i) for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert out == [(-1, 0), (1, 0), (1, 0), (2, 40), (3, 0)]
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []
    kept = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, "a  b", "L")], "doc_id long, text string, lang string"), carry=("lang",), keep_unchanged=True).collect()}
    assert (kept[1]["kept_text"], kept[1]["lang"]) == ("a  b", "L")


def shingles(text, n):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = SPACE.findall(text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(rows, n):
    sets = {i: shingles(x, n) for i, x, *_ in rows}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("shingle", [4, 5])
@pytest.mark.parametrize("limits", [None, (4, 3, 200), (3, 1000, 100)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, shingle, limits):
    if limits:  # nodes, balls and groups beyond their limits
        for name, value in zip(("NODE", "BALL", "GROUP_TOKENS"), limits):
            monkeypatch.setattr(near_dedup, name, value)
    rows = corpus(5)
    out = near_dedup.components(spark.createDataFrame(rows, DDL).repartition(3), shingle=shingle).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, shingle)


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (5, ""), (6, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["component_id"]) for r in near_dedup.components(df).collect())
    assert out == [(-1, None), (2, 2), (5, 5), (6, 6), (7, 2), (7, 2)]
    assert near_dedup.components(df.limit(0)).collect() == []


def test_members_close_to_a_pivot_stand_in_no_later_ball_and_no_partners_part():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, base = 120, rng.integers(0, 1 << 32, near_dedup.COORDS, dtype=np.uint32)
    own = np.tile(base, (n, 1))
    for i in range(n):  # the first half close to all pivots, the others at any distance
        change = rng.choice(near_dedup.COORDS, rng.integers(0, 6 if i < 60 else 34), replace=False)
        own[i, change] = rng.integers(0, 1 << 32, len(change), dtype=np.uint32)
    pivots = [{"rep": j, "sketch": own[j].tobytes()} for j in (3, 90, 70)]
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("sketch", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([9] * n), pa.array(range(n)), pa.array([50] * n), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([pivots] * n, kind)], ["node", "rep", "n", "sketch", "pivots"])
    balls, stay = {}, set()
    for out in near_dedup._large_nodes([pa.RecordBatch.from_arrays(batch.slice(50).columns, batch.schema.names), batch.slice(0, 50)]):  # also a slice
        for r in out.to_pylist():
            stay.add(r["rep"]) if r["ball"] is None else balls.setdefault(r["rep"], set()).add(r["ball"])
    assert all(balls[i] == {3} for i in range(60))
    for i in range(n):
        for j in range(i):
            if (own[i] == own[j]).sum() >= 33:
                assert balls.get(i, set()) & balls.get(j, set()) or {i, j} <= stay, (i, j)


def test_texts_without_a_candidate_are_not_packed(spark, monkeypatch):
    written, cut = {}, near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    near = " ".join(f"n{i}" for i in range(100))
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(20)] + [(30, near), (31, near + " end")], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.components(df).collect()}
    assert out == {i: i for i in range(20)} | {30: 30, 31: 30}
    assert sorted(r["rep"] for r in written["asked-texts"].collect()) == [30, 31]
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", 0)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.components(df).collect()} == out


def test_few_rows_of_large_nodes_meet_the_sketches_without_a_shuffle(spark, monkeypatch):
    written, cut = [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df, name: written.append(name) or cut(df, name))
    monkeypatch.setattr(near_dedup, "NODE", 4)
    rows = corpus(5)
    out = lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.components(spark.createDataFrame(rows, DDL)).collect()}
    assert out() == brute_components(rows, 5)
    assert "level" in written and not {"pivots", "asked"} & set(written)
    monkeypatch.setattr(near_dedup, "MOST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", 0)
    assert out() == brute_components(rows, 5)
    assert {"pivots", "asked"} <= set(written)


def test_stars_are_components_without_a_round(spark, monkeypatch):
    written, cut = [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df, name: written.append(name) or cut(df, name))
    out = {r["vertex"]: r["least"] for r in near_dedup.connected(spark.createDataFrame([(1, 2), (3, 1), (1, 2), (7, 8)], "a long, b long")).collect()}
    assert out == {2: 1, 3: 1, 8: 7} and len(written) == 1


def test_connected_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (100, 102), (102, 100), (5, 5)]
    out = {r["vertex"]: r["least"] for r in near_dedup.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, n):
    low = lambda x: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    grams = {}
    for i, x in items:
        w = low(x)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = {}
    for i, x, *_ in docs:
        w, hit, found = low(x), set(), set()
        for size in {len(g) for g in grams}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in grams:
                    hit |= set(range(s, s + size))
                    found |= grams[tuple(w[s : s + size])]
        out[i] = (len(w), hit, found)
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_contamination_equals_brute_force(spark, most):
    docs = corpus(8)
    items = [(1, " ".join((docs[4][1] or "x").split()[3:40])), (2, "same same"), (3, None), (4, "..."), (5, "one"), (6, "É-Üb  w3"), (5, "one")]
    out = decontaminate.find_contamination(spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id long, text string"), most_windows=most).collect()
    assert {r["doc_id"]: (r["n_words"], {x - 1 for x in r["hits"]}, set(r["items"])) for r in out} == brute_contamination(docs, items, 13)
    assert len(out) == len(docs)


def test_contamination_odd_rows_and_removal(spark):
    words = " ".join(f"q{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"Keep, {words.upper()}; this.", "a"), (1, f"Keep, {words.upper()}; this.", "a"), (2, "clean text", "b"), (None, words, "c"), (3, None, "d")], "doc_id long, text string, items string")
    items = spark.createDataFrame([(9, words)], "item_id long, text string")
    found = decontaminate.find_contamination(docs, items)
    assert sorted((r["doc_id"] or -1, r["n_words"], len(r["hits"])) for r in found.collect()) == [(-1, 13, 13), (1, 15, 13), (1, 15, 13), (2, 2, 0), (3, 0, 0)]
    assert sorted(r["items"] for r in decontaminate.remove_documents(docs, items).collect()) == ["b", "d"]
    assert sorted((r["items"], r["text"]) for r in decontaminate.remove_spans(docs, items).collect() if r["items"] == "a")[0][1].replace(" ", "") == "Keep,;this."
    clash = docs.select("doc_id", "text", docs["items"].alias("_hits"), docs["items"].alias("hits"), docs["items"].alias("print"))
    assert sorted((r["hits"], r["text"].replace(" ", "")) for r in decontaminate.remove_spans(clash, items).collect() if r["doc_id"] == 1) == [("a", "Keep,;this.")] * 2
    unnamed = decontaminate.find_contamination(docs, items.selectExpr("cast(null as long) as item_id", "text")).collect()
    assert all(len(r["hits"]) == (13 if r["doc_id"] in (None, 1) else 0) and r["items"] == [] for r in unnamed)
    long = spark.createDataFrame([(1, "z " * 200_000 + words)], "doc_id long, text string")
    assert [(r["n_words"], len(r["hits"])) for r in decontaminate.find_contamination(long, items).collect()] == [(200_013, 13)]
    none = decontaminate.find_contamination(docs, items.limit(0)).collect()
    assert len(none) == 5 and not any(r["hits"] for r in none)
    assert decontaminate.find_contamination(docs.limit(0), items).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = [x for _, x, *_ in corpus(9)] + ["<|endoftext|> it's  they'll \n\n x ", "日本語 \x85 \x1c a", "word " * 400_000, "y" * 3000, None]
    if path.endswith(".model"):
        import sentencepiece

        count = lambda x, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(x))
    else:
        from tokenizers import Tokenizer

        count = lambda x, m=Tokenizer.from_file(path): len(m.encode(x, add_special_tokens=False))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in token_count.count_tokens(df, path).collect()}
    for i, x in enumerate(texts):
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((x or "").encode()), count(x or ""), count(x or "") > 1024)
    assert token_count.count_tokens(df.limit(0), path).collect() == []


def test_long_texts_split_where_the_pattern_cuts():
    text = "ab  cd ef\n gh " * 50
    parts = token_count._parts(text, 40)
    assert "".join(parts) == text and len(parts) > 5
    assert all(x[0] == " " and x[1] != " " for x in parts[1:])


def test_digest_of_kept_words(spark, sf_dir):
    rows = substring_dedup.op3_substring_dedup(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_repeats(list(texts.items()), 20)
    assert {r["doc_id"]: r["kept_sha256"] for r in rows} == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in want.items()}
