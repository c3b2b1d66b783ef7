"""Toxicity of texts by noisy-channel deobfuscation and a lexicon that labels teach.

1. A character trigram model is counted over all texts: each task sums its own table, tables are summed by shuffle.
2. Deobfuscation: tokens with leetspeak, letters three times in a row, spaced-out letters or signs inside words become lattices.
   A leet sign may stand for its letters, a repeated letter and a separator may be dropped, each at a channel cost;
   Viterbi finds the restored word that channel and trigram model together make likeliest. A clean token's lattice has one
   path, so it is its own restoration and no lattice is built.
3. Features of a restored word are the word and its first 4, 5 and 6 bytes. From labelled rows a feature enters the lexicon if toxic
   texts hold it significantly more often (log-likelihood ratio), at least SHARE of them do, and clean ones never or RATIO times
   more rarely. Near copies of a text
   count once (by their least five-word shingle). The fit sees all labelled rows up to MOST_TOXIC and MOST_CLEAN; beyond these
   bounds, a hash of the id picks about so many.
4. Score: logistic function of BIAS plus, for each distinct word, its best feature's log ratio (at most CAP).

Null texts are empty; a text without words scores logistic(BIAS). Labels other than 0 and 1, or null, teach nothing; with no toxic
label the lexicon is empty. Rows repeated with one id teach once. Ids, languages, sources and labels are no inputs of a score.
Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, ship

ship(__name__)

MOST_TOXIC, MOST_CLEAN = 6_000, 12_000
RATIO, LLR, LEAST, SHARE, CAP, BIAS, REJECT = 100.0, 28.0, 4, 0.01, 4.0, -3.0, 0.7
PREFIXES = (4, 5, 6)
SYMBOLS = 28
#: Signs and the letters for which they stand.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SWAP_COST, DROP_COST, REPEAT_COST = -1.0, -0.5, -0.5
SEPARATORS = " .-_*~^,'"


def _classes():
    """Of each byte its symbol: 0 is no letter, 1 to 26 are a to z, 27 is a byte of another character."""
    import numpy as np

    table = np.zeros(256, np.int64)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(1, 27)
    table[0x80:] = 27
    return table


def _trigrams(batches):
    """The trigrams that a task has met, with counts."""
    import numpy as np
    import pyarrow as pa

    total, table = np.zeros(SYMBOLS**3, np.int64), _classes()
    for batch in batches:
        for part in K.slices(batch, "text"):
            data, offsets = K.buffer(part.column("text"))
            symbol = np.concatenate(([0], table[data], [0]))
            code = symbol[:-2] * SYMBOLS**2 + symbol[1:-1] * SYMBOLS + symbol[2:]
            inside = np.ones(len(data) + 1, bool)
            inside[offsets] = False
            total += np.bincount(code[(symbol[1:-1] > 0) & inside[:-1] & inside[1:]], minlength=SYMBOLS**3) if len(data) else 0
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["code", "times"])


def language_model(documents: DataFrame, text_col: str = "text"):
    """Log probabilities of each symbol after two others, from all texts: an array of SYMBOLS cubed numbers."""
    import numpy as np

    counts = documents.select(F.col(text_col).alias("text")).mapInArrow(_trigrams, "code int, times long").groupBy("code").agg(F.sum("times").alias("times"))
    table = np.full(SYMBOLS**3, 0.1)
    for code, times in counts.toLocalIterator():  # at most SYMBOLS cubed rows
        table[code] += times
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(table / table.sum(axis=2, keepdims=True)).astype(np.float32).ravel()


def restore_word(token: str, model) -> str:
    """The likeliest clean word behind a noisy token (lower case): Viterbi over its lattice; a state is the last two symbols."""
    symbol = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
    states: dict = {(0, 0): (0.0, None)}  # score, and the path as a chain of letters from the last one, so that long tokens take linear time
    for i, c in enumerate(token):
        run = i and token[i - 1] == c
        if c in LEET:
            arcs = [(x, SWAP_COST) for x in LEET[c]] + ([("", REPEAT_COST)] if run else [])
        elif c in SEPARATORS or not c.isalpha():
            arcs = [("", DROP_COST)]
        else:
            arcs = [(c, 0.0)] + ([("", REPEAT_COST)] if run else [])
        after: dict = {}
        for (a, b), (score, word) in states.items():
            for x, cost in arcs:
                if x:
                    s = symbol(x)
                    state, new = (b, s), (score + cost + float(model[a * SYMBOLS**2 + b * SYMBOLS + s]), (word, x))
                else:
                    state, new = (a, b), (score + cost, word)
                if state not in after or new[0] > after[state][0]:
                    after[state] = new
        states = after
    word, letters = max(((score + float(model[a * SYMBOLS**2 + b * SYMBOLS]), word) for (a, b), (score, word) in states.items()), key=lambda x: x[0])[1], []
    while word:
        word, x = word
        letters.append(x)
    return "".join(reversed(letters))


def _patterns():
    import re

    leet = re.escape("".join(LEET))
    letter = r"[^\W\d_]"
    spaced = re.compile(rf"(?<![\w{leet}])(?:{letter}|[{leet}])(?:([ .\-_*~^,])(?:{letter}|[{leet}]))(?:\1(?:{letter}|[{leet}])){{2,}}(?![\w{leet}])")
    noisy = re.compile(rf"(?=[^\s]*{letter})[{leet}]?{letter}(?:{letter}|[{leet}]|[.\-_*~^'](?={letter}|[{leet}]))*")
    sign = re.compile(rf"[{leet}_*~^](?={letter}|[{leet}])|({letter})\1\1")
    return spaced, noisy, sign


def restore_text(text: str, model, kept: dict[str, str]) -> str:
    """A lower-cased text with its noisy tokens restored."""
    spaced, noisy, sign = _PATTERNS[0] if _PATTERNS else _PATTERNS.append(_patterns()) or _PATTERNS[0]

    def clean(found):
        token = found[0]
        if len(token) > 64:  # not kept: seldom met again
            return restore_word(token, model)
        if token not in kept:
            if len(kept) > 200_000:
                kept.clear()
            kept[token] = restore_word(token, model)
        return kept[token]

    text = spaced.sub(clean, text)
    return noisy.sub(lambda m: clean(m) if sign.search(m[0]) else m[0], text)


_PATTERNS: list = []


def _flagged(data, offsets):
    """The documents of a slice that may hold noisy tokens: all that the patterns of restore_text match, and others.

    Texts with a byte beyond ASCII are all flagged, as lower case and repeated letters can't be told from bytes there. In the others a
    sign of a token stands before a letter, or before a sign and after a letter or separator.
    """
    import numpy as np

    letter = _classes() > 0
    sign, mark, joint = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    sign[[ord(x) for x in LEET if ord(x) < 128]] = True
    mark[[ord(x) for x in "_*~^"]] = True
    joint[[ord(x) for x in ".-_*~^'"]] = True
    after = lambda x: np.concatenate((x, np.zeros(8, bool)))
    a, s = after(letter[data]), after(sign[data])
    low = np.concatenate((K.FOLD[data], np.zeros(8, np.uint8)))
    n = len(data)
    before = np.concatenate(([False], (a | s)[: n - 1])) if n else a[:0]
    led = np.concatenate(([False], (letter | joint)[data[: n - 1]])) if n else a[:0]
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    left, right = before.copy(), (a | s)[1 : n + 1].copy()
    left[first], right[last] = False, False
    alone = after((a | s)[:n] & ~left & ~right)
    found = s[:n] & (a[1 : n + 1] | s[1 : n + 1] & led) | a[:n] & (low[:n] == low[1 : n + 1]) & (low[:n] == low[2 : n + 2])
    found |= alone[:n] & alone[2 : n + 2] & alone[4 : n + 4] & alone[6 : n + 6]
    found |= mark[data] & before & (a | s)[1 : n + 1]
    found |= data >= 0x80
    total = np.concatenate(([0], np.cumsum(found)))
    return np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]])


def restored(texts, model, kept: dict[str, str]):
    """A string array with the noisy tokens of each text restored."""
    import pyarrow as pa

    data, offsets = K.buffer(texts)
    flagged = _flagged(data, offsets)
    if not len(flagged):
        return texts
    out = texts.to_pylist()
    for i in flagged.tolist():
        out[i] = restore_text(out[i].lower(), model, kept)
    return pa.array(out, pa.large_string())


def _word_features(words):
    """Rows of features, one column for each word: the word, and its prefixes."""
    import numpy as np

    data = K.FOLD[words.data]
    out = [words.hash]
    for n in PREFIXES:
        cut = np.minimum(words.start + n, words.end)
        out.append(K.mix(K.spans(K.BYTE_VALUE[data], words.start, cut, K.BASES[0]) + K.U(n)))
    return np.stack(out)


def _letters_only():
    return _classes() == 0


def _train_features(model):
    """Of each labelled row: its label, near-copy signature and features, all distinct."""

    def train_features(batches):
        import numpy as np
        import pyarrow as pa

        kept: dict[str, str] = {}
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(restored(part.column("text"), model, kept), _letters_only(), fold=True)
                features = _word_features(words)
                grams = K.mix(words.grams(5, K.BASES[1]))
                grams[~words.whole(5)] = ~K.U(0)
                lists, prints = [], []
                for a, b in zip(words.first[:-1], words.first[1:]):
                    lists.append(np.unique(features[:, a:b]).view(np.int64))
                    least = grams[a:b].min() if b > a else ~K.U(0)
                    prints.append(least if least != ~K.U(0) else K.mix(np.array([words.hash[a:b].sum()], K.U))[0])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.array(prints, K.U).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["label", "print", "features"])

    return train_features


def weights(a, b, n1: float, n0: float):
    """Of features that a of n1 toxic and b of n0 clean texts hold: which enter the lexicon, and their log ratios."""
    import numpy as np

    share = (a + b) / max(1.0, n1 + n0)
    part = lambda x, p: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(p, 1e-12)), 0)
    llr = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    ratio = (a + 0.25) / (n1 + 1) / ((b + 0.25) / (n0 + 1))
    return (llr >= LLR) & ((b == 0) | (ratio >= RATIO)), np.minimum(np.log(ratio), CAP)


def fit(labelled: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> dict[int, float]:
    """The lexicon, from all labelled rows or about most_toxic and most_clean of them: feature to weight."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = {y: min(1.0, most / max(1, sizes.get(y, 0))) for y, most in ((0, most_clean), (1, most_toxic))}
    place = F.pmod(F.xxhash64("id", F.lit(41)), F.lit(1 << 20)) / float(1 << 20)
    some = rows.filter(place < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).select("text", "label")
    import numpy as np

    texts = cut(some.mapInArrow(_train_features(model), "label int, print long, features array<long>"), "train")
    known = {r["label"]: r["n"] for r in texts.select("label", "print").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(known.get(1, 0)), float(known.get(0, 0))
    once = texts.select("label", "print", F.explode("features").alias("feature")).distinct()
    counts = once.groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    often = counts.filter(F.col("a") >= max(LEAST, SHARE * n1)).collect()  # a text holds a bounded share of these: at most its number of features over SHARE, on average
    if not often:
        return {}
    good, weight = weights(np.array([float(r["a"]) for r in often]), np.array([float(r["b"]) for r in often]), n1, n0)
    return {r["feature"]: float(w) for r, g, w in zip(often, good, weight) if g}


def _score(model, lexicon: dict[int, float]):
    import numpy as np

    known = np.array(sorted(lexicon), np.int64)
    weights = np.array([lexicon[int(x)] for x in known])

    def score(batches):
        import numpy as np
        import pyarrow as pa

        kept: dict[str, str] = {}
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(restored(part.column("text"), model, kept), _letters_only(), fold=True)
                best = np.zeros(len(words.hash))
                if len(known):
                    for feature in _word_features(words).view(np.int64):
                        at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
                        best = np.maximum(best, np.where(known[at] == feature, weights[at], 0))
                hit = np.flatnonzero(best)
                order = hit[np.lexsort((words.hash[hit], words.doc[hit]))]
                new = np.ones(len(order), bool)
                new[1:] = (words.doc[order[1:]] != words.doc[order[:-1]]) | (words.hash[order[1:]] != words.hash[order[:-1]])
                total = np.bincount(words.doc[order[new]], best[order[new]], part.num_rows)
                columns = {x: part.column(x) for x in part.schema.names if x != "text"} | {"score": pa.array(1 / (1 + np.exp(-(BIAS + total))))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return score


def score_texts(documents: DataFrame, model, lexicon: dict[int, float], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents' doc_id, `carry` columns and score."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = documents.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text_col).alias("text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    return rows.mapInArrow(_score(model, lexicon), schema).select("doc_id", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "score")


def is_held_out(doc_id: Column) -> Column:
    """A third of the ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame):
    """The language model of all texts, and the lexicon of the labelled texts that are not held out."""
    model = language_model(documents)
    known = labels.select("doc_id", "toxic").filter("toxic is not null").dropDuplicates(["doc_id"]).filter(~is_held_out(F.col("doc_id")))
    return model, fit(documents.select("doc_id", "text").join(known, "doc_id"), model)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels.toxic teaches where crc32 of the id mod 3 is not 1."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(documents, *learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
