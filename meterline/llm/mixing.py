"""Mixing to target weights by soft membership.

1. Domains are combinations of the label table's classes: toxic, high quality and low quality. A naive Bayes classifier over binned text
   statistics gives every document a posterior for each domain. Two of the statistics are lexical: the summed log ratios of the
   document's distinct words between toxic and other labelled documents, and between low and high quality. Words are counted in
   BUCKETS hash buckets; a bucket has a weight if its log-likelihood ratio is significant (LLR). Words are weighed on one half of the labelled
   documents and bins are counted on the other, so that posteriors aren't overconfident. The classifier is fitted on at most about
   MOST_LABELS labelled documents, picked by a hash of the id; beyond that bound more labels would only be a larger table to broadcast.
2. A document with n words has n * p(domain) expected words in each domain. Rates w >= 0, one a document, are fitted so that the
   expected totals sum(w * n * p) equal the targets: least squares by projected gradient, with its lazy projection: rates are
   max(0, 1 - p u) for the sum u of all steps, so of rates that meet the targets those nearest to 1 (weighed by n) are found. A step is the gradient,
   scaled by the inverse of sum(n p p') over the documents whose rate isn't 0, which are those that can give way; it is halved until the objective falls
   as it should, so no step can run away. DAMPING weighs distance from 1 against distance from the targets; it keeps the answer unique.
3. A step needs one sum over all documents of a few numbers for each pair of domains. A document's rate follows from u alone, so steps write
   nothing, and a lost executor costs part of one sum.

Only DataFrame functions are used; the driver holds vectors of as many numbers as there are domains.

Nulls: a null text has no words; it has a posterior (that of the empty text) and a rate, but adds nothing. Labels that are null belong
to no class. Without labelled documents all domains are equally likely. Rows repeated with one id are rated each; in the fit of the
classifier they count each. If the targets cannot be met with rates >= 0, the rates come as near as the steps reach; the column residual
says how far off they are (the largest difference of a domain's total from its target, as a share of all words). An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DOMAINS = ("high_quality", "low_quality", "toxic")
#: Shares of all words; totals within CLOSE of all words are met.
TARGETS = {"high_quality": 0.85, "low_quality": 0.12, "toxic": 0.03}
BINS, STEPS, CLOSE = 12, 60, 1e-6
#: How much rates far from 1 count against totals far from the targets, a share of all words.
DAMPING = 1e-10
BUCKETS, LLR, CAP, MOST_LABELS = 1 << 15, 20.0, 4.0, 40_000


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain's number of a labelled document, null if its labels are."""
    return F.when(toxic == 1, 2).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 0)


def words_of(text: Column) -> Column:
    """The words of a text: runs of letters, digits and characters beyond ASCII, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def to_bin(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x).cast("int")))


def buckets_of(distinct: Column) -> Column:
    """The hash buckets of words."""
    return F.transform(distinct, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))


def statistics(text: Column, words: Column, distinct: Column) -> tuple[Column, list[Column]]:
    """The number of words, and the binned statistics of a text: length, mean word length, distinct words, non-ASCII share, signs."""
    text = F.coalesce(text, F.lit(""))
    n, chars = F.size(words), F.length(text)
    part = lambda x, y, width: to_bin(F.coalesce(F.try_divide(x, y), F.lit(0)) * width)
    return n, [
        to_bin(F.log2(chars + 1) / 1.5), part(chars, n, 0.8), part(F.size(distinct), n, BINS),
        part(F.octet_length(text) - chars, chars, 60), part(F.regexp_count(text, F.lit(r"[!%&*$#|]")), chars, 40),
    ]


def lexicon(rows: DataFrame) -> list[dict[int, float]]:
    """From rows (buckets, domain): the weights of buckets for toxic against other documents, and for low against high quality. At most BUCKETS rows reach the driver."""
    from math import log

    def llr(a: float, n1: float, b: float, n0: float) -> float:
        p = (a + b) / (n1 + n0)
        part = lambda x, y: x * log(x / y) if x > 0 else 0.0
        return 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * (1 - p)) + part(n0 - b, n0 * (1 - p)))

    count = [F.count_if(F.col("domain") == d).alias(f"d{d}") for d in range(len(DOMAINS))]
    high, low, toxic = rows.agg(*count).first()
    out: list[dict[int, float]] = [{}, {}]
    for r in rows.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*count).collect():
        for which, (a, n1, b, n0) in enumerate(((r["d2"], toxic, r["d0"] + r["d1"], high + low), (r["d1"], low, r["d0"], high))):
            if n1 and n0 and 0 < a + b < n1 + n0 and llr(a, n1, b, n0) >= LLR:
                out[which][r["bucket"]] = max(-CAP, min(CAP, log((a + 0.25) / (n1 + 1) / ((b + 0.25) / (n0 + 1)))))
    return out


def lexical(buckets: Column, weights: list[dict[int, float]]) -> list[Column]:
    """The binned lexical statistics: the sums of weights, 0 in the middle bin but one."""
    out = []
    for one in weights:
        table = F.from_json(F.lit("[" + ",".join(f"{one.get(i, 0):.3f}" for i in range(BUCKETS)) + "]"), "array<float>")  # folded to a constant
        total = F.aggregate(buckets, F.lit(0.0).cast("double"), lambda s, x: s + F.get(table, x))
        out.append(to_bin(total * 0.75 + BINS // 3))
    return out


def _fit(rows: DataFrame, n_bins: int) -> list[list[list[float]]]:
    """Of each statistic and bin the domains' log likelihoods, and as a last member the log priors; from counts of labelled rows."""
    from math import log

    named = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.get("bins", F.lit(i)).alias("bin")) for i in range(n_bins)], F.struct(F.lit(n_bins).alias("which"), F.lit(0).alias("bin"))))
    counts = rows.filter("domain is not null").select("domain", named.alias("x")).groupBy("domain", "x.which", "x.bin").count().collect()
    table = [[[1.0] * len(DOMAINS) for _ in range(BINS)] for _ in range(n_bins + 1)]
    for r in counts:
        table[r["which"]][r["bin"]][r["domain"]] += r["count"]
    totals = [sum(table[n_bins][0][d] for _ in (0,)) for d in range(len(DOMAINS))]
    logs = [[[log(cell[d] / (totals[d] + BINS)) for d in range(len(DOMAINS))] for cell in one] for one in table[:n_bins]]
    return [*logs, [[log(x / sum(totals)) for x in totals]]]


def posteriors(bins: Column, model: list[list[list[float]]]) -> Column:
    """An array of the domains' posteriors."""
    lookup = lambda i, d: F.get(F.array(*[F.lit(cell[d]) for cell in model[i]]), F.get(bins, F.lit(i)))
    scores = []
    for d in range(len(DOMAINS)):
        score = F.lit(model[-1][0][d])
        for i in range(len(model) - 1):
            score = score + lookup(i, d)
        scores.append(score)
    top = F.greatest(*scores)
    odds = F.array(*[F.exp(s - top) for s in scores])
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def _dot(p: Column, u: Column) -> Column:
    out = F.get(p, F.lit(0)) * F.get(u, F.lit(0))
    for d in range(1, len(DOMAINS)):
        out = out + F.get(p, F.lit(d)) * F.get(u, F.lit(d))
    return out


def rate(p: Column, steps: list[list[float]]) -> Column:
    """A document's rate after the steps, vectors with their momentum, which is 0 here: from 1 on, each projected on rates >= 0."""
    w = F.lit(1.0)
    for *u, _ in steps:
        w = F.greatest(F.lit(0.0), w - _dot(p, F.array(*[F.lit(float(x)) for x in u])))
    return w


def descend(measure, wanted):
    """All steps as one vector u, and how far off the totals stay, from measure(u): for rates max(0, 1 - p u) the totals of the domains, sum(n p p') over rates that aren't 0, and sum(n rate^2).

    Each step is the gradient scaled by the inverse of that matrix and DAMPING; it is halved until the objective falls as it should.
    """
    import numpy as np

    size, wanted = max(1.0, float(np.sum(wanted))), np.array(wanted, float)
    u, part, best = np.zeros(len(wanted)), 1.0, None
    step = slope = None
    for _ in range(STEPS):
        totals, free, squares = measure(u)
        off = totals - wanted
        value = float(wanted @ u + squares / 2 + DAMPING * size * (u @ u) / 2)
        residual = float(np.abs(off).max() / size)
        if best is not None and part > 1e-6 and value > best[0] - 1e-4 * part * slope:
            part /= 2
            u = best[1] + part * step
            continue
        best = value, u, residual
        gradient = off - DAMPING * size * u
        if np.abs(gradient).max() <= CLOSE * size / 10:
            break
        step, part = np.linalg.solve(np.array(free, float) + DAMPING * size * np.eye(len(wanted)), gradient), 1.0
        slope = float(gradient @ step)
        u = u + step
    return best[1], best[2]


def fit_rates(rows: DataFrame, targets: list[float]) -> tuple[list[list[float]], float]:
    """The projected gradient's steps as one, for documents with columns n and p, to expected totals of `targets` words, and how far off the totals stay. A step is one sum over all documents."""
    import numpy as np

    k = range(len(DOMAINS))
    n, p = F.col("n"), F.col("p")

    def measure(u):
        w = rate(p, [[*u, 0.0]])
        sums = [F.sum(w * n * F.get(p, F.lit(i))) for i in k] + [F.sum(F.when(w > 0, n * F.get(p, F.lit(i)) * F.get(p, F.lit(j)))) for i in k for j in k] + [F.sum(n * w * w)]
        got = np.array(rows.agg(*[F.coalesce(x, F.lit(0.0)) for x in sums]).first(), float)
        return got[: len(DOMAINS)], got[len(DOMAINS) : -1].reshape(len(DOMAINS), len(DOMAINS)), got[-1]

    u, residual = descend(measure, targets)
    return [[*map(float, u), 0.0]], residual


def mix(documents: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents' doc_id, `carry` columns, n_words, p_<domain>, rate, copies: how often to take each (the rate, its fraction by a hash of the id), and residual."""
    shares = shares or TARGETS
    if set(shares) != set(DOMAINS) or min(shares.values()) < 0:
        raise ValueError(f"a share >= 0 is needed for each of {DOMAINS}")
    classes = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("domain is not null").dropDuplicates(["doc_id"])
    part = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    some = cut(classes.filter(part(3) < min(1.0, MOST_LABELS / max(1, classes.count()))).withColumn("half", part(4) < 0.5), "labels")  # about MOST_LABELS rows
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learned = texts.join(F.broadcast(some.filter("half")), "doc_id").repartition(F.col("doc_id"))  # so that words are made of these texts only
    weights = lexicon(learned.select("domain", F.array_distinct(buckets_of(words_of(F.col("text")))).alias("buckets")))
    split = lambda df: df.withColumn("words", words_of(F.col("text"))).withColumn("distinct", F.array_distinct("words"))
    n, bins = statistics(F.col("text"), F.col("words"), F.col("distinct"))
    described = lambda df, *kept: split(df).select(*kept, n.cast("long").alias("n"), F.array(*bins).alias("bins"), buckets_of(F.col("distinct")).alias("buckets")).select(*kept, "n", F.concat("bins", F.array(*lexical(F.col("buckets"), weights))).alias("bins"))
    rows = cut(described(texts, "doc_id"), "statistics")
    other = rows.select("doc_id", "bins").join(F.broadcast(some.filter("not half")), "doc_id")
    model = _fit(other, len(bins) + len(weights))
    rows = cut(rows.withColumn("p", posteriors(F.col("bins"), model)).drop("bins"), "posteriors")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scale = sum(shares.values()) or 1.0
    steps, residual = fit_rates(rows.filter("n > 0").select("n", "p"), [total * shares[d] / scale for d in DOMAINS])
    if carry:  # another scan rather than a shuffle or a copy of the carried columns
        carried = documents.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text_col).alias("text"))
        rows = described(carried, "doc_id", *[f"carry_{i}" for i in range(len(carry))]).withColumn("p", posteriors(F.col("bins"), model))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 24)) / float(1 << 24)
    rows = rows.withColumn("rate", rate(F.col("p"), steps))
    copies = (F.floor("rate") + F.when(place < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return rows.select("doc_id", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], F.col("n").alias("n_words"), *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies.alias("copies"), F.lit(residual).alias("residual"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates of all documents for the shares of TARGETS of all words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
