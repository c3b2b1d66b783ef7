"""WARC archives, chat logs, main text, toxicity, mixing and image copies on small tables with odd rows."""

import gzip

import numpy as np
import pytest

from meterline.llm import chat, common, html_extract, image_copies, kernels, mixing, toxicity, warc


def test_archives_read_back(spark):
    pages = [(5, "http://a/1", "<p>é</p>", 1), (2, "http://a/2", "<p>é</p>", 1), (9, None, None, 1), (8, "u r\nl", "", 1), (2, "http://a/2", "<p>é</p>", 1), (None, "x", "<p>é</p>", 1), (11, "y", "z" * 3_000_000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, shard int")
    out_dir = common.scratch(spark, "test-warc")
    manifest = warc.write_archives(df, out_dir, shard_bytes=2000, roll_bytes=500)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, out_dir).collect())
    assert got == [(-1, 9, "response", None), (2, 9, "response", None), (2, 9, "response", None), (5, 9, "revisit", 2), (8, 0, "response", None), (9, 0, "revisit", 8), (11, 3_000_000, "response", None)]
    again = common.scratch(spark, "test-warc")
    warc.write_archives(df.repartition(3), again, shard_bytes=2000, roll_bytes=500)
    content = lambda d: {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{d}/*.warc.gz").collect()}
    assert content(out_dir) == content(again)
    first = gzip.decompress(content(out_dir)[sorted(content(out_dir))[0]])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert warc.read_archives(spark, common.scratch(spark, "none")).collect() == []
    empty = common.scratch(spark, "empty")
    assert warc.write_archives(df.limit(0), empty).collect() == [] and warc.read_archives(spark, empty).collect() == []


def test_shards_hold_about_their_bytes_whatever_the_ids(spark):
    """Dense ids beside far ones, at both ends of long, and many rows without an id: no shard is much over its bytes, and all reads back."""
    ids = [*range(3000), 10**15, 2**63 - 1, -(2**63), -5, *[None] * 500]
    df = spark.createDataFrame([(i, f"http://h/{k}", f"<p>{k}</p>" * 20) for k, i in enumerate(ids)], "page_id long, url string, html string")
    out_dir = common.scratch(spark, "wide")
    shards = warc.write_archives(df, out_dir, shard_bytes=100_000).groupBy("shard").agg({"records": "sum", "first_id": "min", "last_id": "max"}).collect()
    assert sum(r["sum(records)"] for r in shards) == len(ids) and len(shards) > 20 and max(r["sum(records)"] for r in shards) <= 250
    got = sorted((r["page_id"] is not None, r["page_id"] or 0, r["url"]) for r in warc.read_archives(spark, out_dir).collect())
    assert got == sorted((i is not None, i or 0, f"http://h/{k}") for k, i in enumerate(ids))
    spans = sorted((r["min(first_id)"], r["max(last_id)"]) for r in shards if r["min(first_id)"] is not None)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_damaged_archives_are_found(spark):
    out_dir = common.scratch(spark, "damaged")
    warc.write_archives(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), out_dir)
    path = spark.read.format("binaryFile").load(f"{out_dir}/*.warc.gz").first()["path"].removeprefix("file:")
    data = gzip.decompress(open(path, "rb").read()).replace(b"text\r\n\r\n", b"tent\r\n\r\n")
    open(path, "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, out_dir).collect()


def test_chat_events_fold(spark):
    log = [
        (1, 1, 0, "delta", "user", "He"), (1, 2, 0, "delta", None, "llo"), (1, 3, 1, "delta", "assistant", "Hi <|im_end|> 100%25"), (1, 4, 2, "delta", "user", "more"),
        (1, 5, 1, "regenerate", "assistant", "New"), (1, 6, 1, "delta", None, "!"), (1, 7, 2, "delta", "user", "ok"), (1, 8, 0, "edit", None, "Bye"),
        (2, 1, 0, "delta", "us\ner%0A", None), (None, 1, 0, None, None, "x"), (3, 1, None, "delta", "user", "n"), (3, 1, 0, "delta", "user", "b"), (3, 1, 0, "delta", "user", "a"),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in log], "conv_id long, seq long, turn long, kind string, role string, text string, turns string")
    out = {r["conv_id"]: r for r in chat.parse(chat.render(chat.fold_events(df))).collect()}
    turns = lambda i: [tuple(t) for t in out[i]["turns"]]
    assert turns(1) == [("user", "Bye"), ("assistant", "New!"), ("user", "ok")] and out[1]["loss_text"] == "New!"
    assert turns(2) == [("us\ner%0A", "")] and turns(None) == [("user", "x")] and turns(3) == [("user", "n"), ("user", "ab")]
    assert chat.fold_events(df.limit(0)).collect() == []


def test_chat_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\n", "%3C|", "%253C|im%", "<", "<<|", "", "\n\n", "%", "|>", "%0A"]
    rows = [(i, j, j, "delta", role, t) for i, t in enumerate(texts) for j, role in enumerate(["system", "assistant", "user", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    for r in chat.parse(chat.render(chat.fold_events(df))).collect():
        t = texts[r["conv_id"]]
        assert [tuple(x) for x in r["turns"]] == [("system", t), ("assistant", t), ("user", t), ("assistant", t)] and r["loss_text"] == t + t


def brute_chat(log):
    """The fold event by event, from its definition."""
    out = {}
    for conv in {x[0] for x in log}:
        events = sorted((x for x in log if x[0] == conv), key=lambda x: (x[1], x[3] or "delta", x[5] or ""))
        resets = [(x[1], x[2]) for x in events if x[3] == "regenerate"]
        turns = {}
        for _, seq, turn, kind, role, text in events:
            if any(t < turn and seq <= at for at, t in resets):
                continue
            said = turns.setdefault(turn, ["user", "", None])
            said[0] = role or said[0]
            if kind in ("edit", "regenerate"):
                said[1], said[2] = text or "", seq
            elif said[2] is None or seq > said[2]:
                said[1] += text or ""
        out[conv] = [(r, t) for _, (r, t, _) in sorted(turns.items())]
    return {k: v for k, v in out.items() if v}


def test_random_logs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    kinds, roles = ["delta", "delta", "delta", "edit", "regenerate", None], ["user", "assistant", None]
    log = [(int(rng.integers(0, 40)), i, int(rng.integers(0, 5)), kinds[rng.integers(0, 6)], roles[rng.integers(0, 3)], [None, "a", "<|x", "%3C|b"][rng.integers(0, 4)]) for i in range(600)]
    log += [(90, i, int(rng.integers(0, 400)), kinds[rng.integers(0, 6)], "assistant", "x" * int(rng.integers(0, 3000))) for i in range(900)]  # one very long conversation
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(3)
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.parse(chat.render(chat.fold_events(df))).collect()}
    assert got == brute_chat(log)


def test_rows_of_one_turn_are_turns_of_their_own(spark, tmp_path):
    """Ties and repeated rows: the query equals its SQL, and no user text lies under the loss mask."""
    import duckdb

    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, None, "user", "n"), (3, 1, "assistant", None), (4, 2, None, "x"), (4, 1, "assistant", ""), (4, 2, "assistant", "y"), (4, 2, None, None)]
    ddl = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in chat.op8_chat_format(spark, str(tmp_path)).collect())
    want = duckdb.sql(chat.OP8_SQL.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert got == sorted(want) and {r[0]: (r[1], r[3]) for r in got} == {-1: (2, 34), 1: (2, 1), 2: (2, 0), 3: (2, 0), 4: (4, 1)}


PAGE = """<!DOCTYPE html><html><head><title>T &amp;</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="top-menu"><a href="/">Home</a></div><header>Site</header><div class="content"><h1>Caf&eacute; %s</h1><p>First <b>bo</b>ld %s.<br>Next&nbsp;line<p>Unclosed &lt;tag&gt; %s
<div id="share">Share me</div><p>Read this standing line</p></div><aside>Side</aside><section class="comments"><p>nice post</p></section><form>Search</form><footer>&copy; us</footer></body></html>"""


def test_main_text_by_template(spark):
    pages = [(i, f"https://u@Host.example:80/p{i}?q", PAGE % (i, i * 7, f"body {i} " * (i + 3))) for i in range(6)]
    pages += [(90, "http://one.example/", "<article><h2>A</h2>b<nav>no</nav></article><footer>no</footer>"), (91, None, None), (92, "x", ""), (93, "http://one.example/", "<p>cut <b>off <i"), (None, "http://q/", "<p>x"), (None, "http://q/", "<p>x")]
    df = spark.createDataFrame([(*p, "clash", "m") for p in pages], "page_id long, url string, html string, host string, main string")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df).collect()}
    for i in range(6):
        text = f"Café {i} First bold {i * 7}. Next line Unclosed <tag> " + " ".join([f"body {i}"] * (i + 3))
        assert out[i] == (text, len(text))  # the standing line is the template's
    assert out[90] == ("A b", 3) and out[91] == ("", 0) and out[92] == ("", 0) and out[93][0].startswith("cut off") and out[None] == ("x", 1)
    assert html_extract.extract_main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("html,text", [
    ("<article><p class='notice'>no<p>yes</p><li class=ad>no</li>a<b>b</b> c</article>", "yes ab c"),
    ("<body><div class=post><h1>T</h1><p>x<br>y</p></div><div id='comments'><p>no</p></div><script>'<p>no'</script>", "T x y"),
    ("<main><header><h1>Kept</h1></header><p>a &amp; b &#233; &nope; &lt;i&gt;</p><nav>no</nav><select><option>no</select></main>", "Kept a & b é &nope; <i>"),
    ("<article><p>one</p><!-- no --><p style='display: none'>no</p><p hidden>no</p><table><tr><td>two<td>three</table></article>", "one two three"),
    ("<div id='page' class='layout with-sidebar'><p>Story text</p></div><div class='sidebar-left'>no</div>", "Story text"),
    ("<article><div class='article-header'><h1>Head</h1></div><p>Story</p><p class='related-work'>Related work</p><div class='related-posts'>no</div></article>", "Head Story Related work"),
    ("<body><p title='a > b' data-x=\"it's\">quoted</p><p>it's \"fine\"</p>", "quoted it's \"fine\""), ("<p>open <b title='never closed>x</b> on</p><p>more", "open x on more"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep after"), ("<svg>a<svg>b", "ab"),
    ("just text", "just text"), ("<p>a < b <p", "a < b <p"), ("<article", "<article"),
])
def test_main_text_of_one_page(html, text):
    assert html_extract.main_text(html, None) == text


def test_broken_pages_take_linear_time():
    import time

    def seconds(html):
        began = time.perf_counter()
        html_extract.main_text(html, None)
        return time.perf_counter() - began

    seconds("<p>warm up")
    for unit in ("<p ", "<", "<svg>", "<p x=\">\" <x \">\" ", "<!--", "<div>", "<div></section>", "<p '\">", "</", "<script", "<a b='"):
        assert seconds(unit * 100_000) < 10, unit


def test_slots_under_their_common_container(spark):
    """A host without article or main: heading and paragraphs beside a longer inner container all belong to the text; standing text and menus don't."""
    rng = np.random.default_rng(0)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    pages, want = [], {}
    for i in range(8):
        head, lead, body, item = words(4), words(8), words(60), words(20)
        pages.append((i, "http://h/", f"<body><div class='top'><a href='/'>Home</a> {i}</div><div class='content'><h1>{head}</h1><p>{lead}</p><div class='body'><p>{body}</p><ul><li>{item}</li></ul></div><div class='comments'>{words(30)}</div></div><div class='legal'>Some standing words</div></body>"))
        want[i] = f"{head} {lead} {body} {item}"
    pages += [(20, "http://h/", ""), (21, "http://h/", None)]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == want | {20: "", 21: ""}
    few = html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), most_bytes=0)
    assert {r["page_id"]: r["text"] for r in few.collect()} == out


def test_classes_equal_brute_force(spark):
    """Tokens with the root's vector are the blocks that stand in every page of the host, counted page by page."""
    rng = np.random.default_rng(1)
    blocks = [f"standing {i}" for i in range(4)] + [f"often {i}" for i in range(4)]
    pages = []
    for i in range(12):
        some = [b for b in blocks if b.startswith("standing") or rng.random() < 0.8]
        pages.append((i, f"http://h{i % 2}/", "<body><div class='a'>" + "".join(f"<p>{b}</p>" for b in some) + f"<p>own {i} {rng.integers(10**9)}</p></div></body>"))
    got = {r["host"]: set(r["constant"]) for r in html_extract.templates(spark.createDataFrame(pages, "page long, url string, html string")).collect()}
    path = ">body>div.a"
    for host in ("h0", "h1"):
        held = [{html_extract._print(path, b) for b in blocks if f"<p>{b}</p>" in html} for _, url, html in pages if f"/{host}/" in url]
        assert got[host] == set.intersection(*held) and len(got[host]) >= 4


def test_repeated_articles_are_no_template(spark):
    html = "<html><body><nav>menu</nav><article><p>the very same article</p></article></body></html>"
    df = spark.createDataFrame([(i, "http://h/", html) for i in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract_main_text(df).collect()} == {"the very same article"}


def test_noisy_words_are_restored(spark):
    docs = spark.createDataFrame([("the idiot and the clown were stupid trash ",)] * 30 + [("a letter to the other reader in the house ",)] * 30, "text string")
    model = toxicity.language_model(docs)
    for noisy, clean in {"1d10t": "idiot", "i d i o t": "idiot", "idiooot": "idiot", "tr4sh": "trash", "$tupid": "stupid", "cl0wn": "clown", "c.l.o.w.n": "clown", "the house": "the house"}.items():
        assert toxicity.restore_text(noisy, model, {}) == clean


def test_trigram_counts_equal_brute_force(spark):
    texts = ["abc ab", None, "", "Zé1z", "aaa"]
    got = {r["code"]: r["times"] for r in spark.createDataFrame([(x,) for x in texts], "text string").mapInArrow(toxicity._trigrams, "code int, times long").groupBy("code").sum("times").withColumnRenamed("sum(times)", "times").collect()}
    want: dict = {}
    for x in texts:
        s = [0, *[int(toxicity._classes()[b]) for b in (x or "").encode()], 0]
        for i in range(1, len(s) - 1):
            if s[i] and 1 < i < len(s) - 2:
                code = s[i - 1] * 784 + s[i] * 28 + s[i + 1]
                want[code] = want.get(code, 0) + 1
    assert got == want


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = np.random.default_rng(2)
    plain = lambda: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(9))
    rows = [(i, plain(), 0) for i in range(80)] + [(100 + i, f"{plain()} {'idiot' if i % 2 else 'clown'} {plain()}", 1) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(999, None, "s"), (998, "", "s"), (None, "1d10t cl0wn", "s"), (997, "you idiot " * 20_000, "s"), (997, "you idiot " * 20_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(998, None), (None, 1), (100, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, *toxicity.learn(docs, labels)).collect()}
    assert all((out[i] >= toxicity.REJECT) == bool(y) for i, _, y in rows)
    assert out[None] > 0.9 and out[997] >= toxicity.REJECT and out[999] == out[998] < 0.1
    nothing = toxicity.learn(docs.limit(0), labels)
    assert nothing[1] == {} and toxicity.score_texts(docs.limit(0), *nothing).collect() == []


def test_lexicon_and_scores_equal_brute_force(spark):
    """Counts of the words and prefixes of clean texts, near copies once; scores summed word by word."""
    import math

    rng = np.random.default_rng(8)
    vocabulary = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(60)] + ["idiot", "idiots", "clown"]
    text = lambda bad: " ".join([vocabulary[x] for x in rng.integers(0, 60, 12)] + (["idiots" if rng.random() < 0.3 else "idiot"] if bad else []))
    rows = [(i, text(i % 2), i % 2) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(50)]  # copies, which count once
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = np.full(toxicity.SYMBOLS**3, -3.0, np.float32)
    lexicon = toxicity.fit(df, model)
    features = lambda t: {(n, w[:n] if n else w) for w in t.split() for n in (0, *toxicity.PREFIXES)}
    texts = {y: {t for _, t, z in rows if z == y} for y in (0, 1)}
    count = {y: {} for y in (0, 1)}
    for y in (0, 1):
        for t in texts[y]:
            for f in features(t):
                count[y][f] = count[y].get(f, 0) + 1
    want, n1, n0 = {}, len(texts[1]), len(texts[0])
    for f, a in count[1].items():
        b = count[0].get(f, 0)
        if a < max(toxicity.LEAST, toxicity.SHARE * n1):
            continue
        cells = ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b))
        llr = 2 * sum(x * math.log(x * (n1 + n0) / (n * m)) for x, n, m in cells if x)
        ratio = (a + 0.25) / (n1 + 1) / ((b + 0.25) / (n0 + 1))
        if llr >= toxicity.LLR and (b == 0 or ratio >= toxicity.RATIO):
            want[f] = min(math.log(ratio), toxicity.CAP)
    assert len(lexicon) == len(want) > 0 and np.allclose(sorted(lexicon.values()), sorted(want.values()))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(df, model, lexicon).collect()}
    for i, t, _ in rows:
        total = sum(max([0, *[want.get((n, w[:n] if n else w), 0) for n in (0, *toxicity.PREFIXES)]]) for w in set(t.split()))
        assert abs(got[i] - 1 / (1 + math.exp(-(toxicity.BIAS + total)))) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.98


def test_screen_holds_all_that_patterns_match():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    model = rng.normal(-3, 1, toxicity.SYMBOLS**3).astype(np.float32)
    texts = ["an a$$", "an a55", "k1$$", "\u00e9\u00e9\u00e9", "\u00e9 \u00e9 \u00e9 \u00e9", "\u0434\u0443\u0440\u0430\u0430\u0430\u043a", "\u00c9\u00e9\u00e9", "x\u20acy", "word", "i d i o", "t.h.e.n", "at", "", "a.55", "a_5", "i" + "d1" * 50]
    texts += ["".join(rng.choice(list("abA5$1! ._*-',(\u00e92\n"), rng.integers(0, 9))) for _ in range(20_000)]
    want = [toxicity.restore_text(t.lower(), model, {}) for t in texts]
    got = toxicity.restored(pa.array(texts, pa.large_string()), model, {}).to_pylist()
    assert [x.lower() for x in got] == want
    long = "i" + "d1" * 50
    assert toxicity.restore_text(long, model, {}) == toxicity.restore_word(long, model) != long


def test_rates_meet_targets_and_equal_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 1, 0.5], 300)
    n = rng.integers(1, 50, 300).astype(float)
    targets = [n.sum() * x for x in (0.85, 0.13, 0.02)]
    df = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p)], "n double, p array<double>")
    steps, residual = mixing.fit_rates(df, targets)
    assert residual <= mixing.CLOSE
    from pyspark.sql import functions as F

    got = np.array([r[0] for r in df.select(mixing.rate(F.col("p"), steps)).collect()])
    w, y = np.ones(300), np.ones(300)
    for *u, beta in steps:
        before, w = w, np.maximum(0, y - p @ np.array(u))
        y = w + beta * (w - before)
    assert np.allclose(sorted(got), sorted(w)) and (got >= 0).all()
    assert np.abs((w * n) @ p - targets).max() <= mixing.CLOSE * sum(targets) * 1.01
    none, residual = mixing.fit_rates(df, [n.sum(), 0.0, 0.0])  # out of reach: the error still falls
    assert residual > mixing.CLOSE
    got = np.array([r[0] for r in df.select(mixing.rate(F.col("p"), none)).collect()])
    assert (got >= 0).all() and abs(got @ (n * 1.0) - n.sum()) < n.sum()


def test_rates_meet_each_domain_of_the_targets(spark):
    """A small domain too is met within a hundredth of its own target, not of all words; defaults are not those that are met soon."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 1, 0.5], 300)
    n = rng.integers(1, 50, 300).astype(float)
    targets = [n.sum() * x for x in (0.85, 0.13, 0.02)]
    df = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p)], "n double, p array<double>")
    rate = mixing.rate(F.col("p"), mixing.fit_rates(df, targets)[0])
    reached = df.agg(*[F.sum(F.col("n") * F.get("p", F.lit(i)) * rate) for i in range(3)]).first()
    assert np.allclose(reached, targets, rtol=1e-2) and np.abs(np.array(reached) - targets).max() <= 1e-6 * sum(targets) * 1.01
    assert mixing.TARGETS == {"high_quality": 0.85, "low_quality": 0.12, "toxic": 0.03}


def test_targets_out_of_reach_come_as_near_as_least_squares(spark):
    """With hardly a toxic word left, no rates meet the toxic target: the error ends at the least that projected gradients in NumPy find, and never above that of the rates 1."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.dirichlet([4, 1], 400), 10 ** rng.uniform(-7, -3, (400, 1))], axis=1)
    p /= p.sum(1, keepdims=True)
    n = rng.integers(1, 50, 400).astype(float)
    targets = n.sum() * np.array([0.85, 0.12, 0.03])
    df = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p)], "n double, p array<double>")
    steps, residual = mixing.fit_rates(df, list(targets))
    from pyspark.sql import functions as F

    order = {(float(a), tuple(map(float, b))): i for i, (a, b) in enumerate(zip(n, p))}
    got = np.array([r["w"] for r in sorted(df.select("n", "p", mixing.rate(F.col("p"), steps).alias("w")).collect(), key=lambda r: order[(r["n"], tuple(r["p"]))])])
    error = lambda w: float(np.linalg.norm((w * n) @ p - targets)) / n.sum()
    a = (n[:, None] * p).T
    w, step = np.ones(400), 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(20_000):
        w = np.maximum(0, w - step * a.T @ (a @ w - targets))
    assert (got >= 0).all() and np.isfinite(got).all() and error(got) <= error(np.ones(400)) and error(got) <= error(w) * 1.001
    assert residual <= 0.03 and abs(residual - np.abs((got * n) @ p - targets).max() / n.sum()) < 1e-6


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (None, "!!!! %%%% ####", "x"), (4, "long " * 50_000, "x"), (1, "a b c", "x")], "doc_id long, text string, n string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, carry=("text", "n")).collect()
    assert len(out) == 6 and all(r["rate"] >= 0 and abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 and r["copies"] >= 0 for r in out)
    assert mixing.mix(docs.limit(0), labels).collect() == [] and len(mixing.mix(docs, labels.limit(0)).collect()) == 6


def test_posteriors_on_held_out_documents(spark):
    """Trained on labels of two thirds of the documents: the largest posterior names the domain of the others, toxic ones too."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(3)) == 0
    out = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter(~held)).join(labels.filter(held), "doc_id")
    p = [F.col(f"p_{d}") for d in mixing.DOMAINS]
    best = F.array_position(F.array(*p), F.greatest(*p)) - 1
    n = {(r["want"], r["got"]): r["count"] for r in out.select(mixing.domain_of(F.col("quality"), F.col("toxic")).alias("want"), best.alias("got")).filter("want is not null").groupBy("want", "got").count().collect()}
    right = sum(v for (a, b), v in n.items() if a == b)
    assert right >= 0.9 * sum(n.values()) and out.first()["residual"] <= mixing.CLOSE
    assert n[2, 2] >= 0.5 * sum(v for (a, _), v in n.items() if a == 2) and n[2, 2] >= 0.85 * sum(v for (_, b), v in n.items() if b == 2)


@pytest.mark.parametrize("most", [300_000, 0])
def test_cropped_and_edited_copies_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(image_copies, "MOST_BROADCAST", most)
    rng = np.random.default_rng(4)

    def picture():
        return rng.integers(20, 235, (8, 8)).repeat(10, axis=0).repeat(10, axis=1).astype(np.uint8)

    pictures = [picture() for _ in range(12)]
    row = lambda i, x: (i, x.shape[1], x.shape[0], x.tobytes(), 0)
    images = [row(i, x) for i, x in enumerate(pictures)] + [row(50, pictures[3]), row(51, pictures[3]), (60, 4, 4, b"123", 0), (61, None, 3, None, 0), (62, 3, None, b"123", 0), (63, None, 3, b"123", 0), (64, -1, -3, b"123", 0), (None, 80, 80, bytes(6400), 0)]
    queries = [row(100 + i, np.rint(x * 0.8 + 25).astype(np.uint8)[5:, :-8]) for i, x in enumerate(pictures)] + [row(200, np.rot90(pictures[5])), row(201, picture()), row(202, np.zeros((40, 40), np.uint8))]
    ddl = "id long, width int, height int, pixels binary, image int"
    out = image_copies.find_copies(spark.createDataFrame(queries, ddl), spark.createDataFrame(images, ddl)).collect()
    found = {(r["query_id"], r["match_id"]): r["copies"] for r in out}
    assert all((100 + i, i) in found for i in range(12)) and (200, 5) in found
    assert found[103, 3] == 3 and all(m == q - 100 or (q, m) == (200, 5) for q, m in found)
    assert image_copies.find_copies(spark.createDataFrame([], ddl), spark.createDataFrame(images, ddl)).collect() == []


def test_kernels_do_not_depend_on_place():
    import pyarrow as pa

    words = kernels.Words(pa.array(["a bb  a bb", "", None, "x y a bb", "üé a", "a b"]))
    grams = words.grams(2, kernels.BASES[1])
    assert words.count.tolist() == [4, 0, 0, 4, 2, 1 + 1] and grams[0] == grams[2] == grams[6] and grams[0] != grams[1]
    assert words.whole(2).tolist() == [True, True, True, False, True, True, True, False, True, False, True, False]


def test_recall_of_edited_copies(spark):
    sf = "/root/testdata/sf0.1"
    found = {r["query_id"]: r for r in image_copies.op6_image_copies(spark, sf).collect()}
    asked = [r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()]
    assert sorted(found) == sorted(asked) and len(asked) >= 20
    assert sum(found[q]["match_id"] == q for q in asked) >= 0.9 * len(asked) and all(found[q]["n_links"] >= 1 for q in asked if found[q]["match_id"] is not None)


def _edits():
    rng = np.random.default_rng(0)

    def rescaled(p, s):
        n = int(len(p) * s)
        at = (np.arange(n) + 0.5) / s - 0.5
        i = np.clip(np.floor(at).astype(int), 0, len(p) - 2)
        f = np.clip(at - i, 0, 1)
        rows = p[i] * (1 - f)[:, None] + p[i + 1] * f[:, None]
        return rows[:, i] * (1 - f) + rows[:, i + 1] * f

    return {
        "gain, offset and crop": lambda p: (p * 0.8 + 30)[7:-5, 4:-9], "noise of 10 greys": lambda p: np.clip(p + rng.normal(0, 10, p.shape), 0, 255), "blur": lambda p: image_copies._blur(image_copies._blur(p)),
        "half": lambda p: p[:, :40], "overlay": lambda p: np.where(np.add.outer(np.arange(80), np.arange(80)) > 100, p / 2 + 100, p), "16 greys": lambda p: p // 16 * 16 + 8, "quarter turn": np.rot90,
        "scale 0.7": lambda p: rescaled(p, 0.7), "scale 0.8": lambda p: rescaled(p, 0.8), "scale 1.3": lambda p: rescaled(p, 1.3),
    }


def test_recall_by_kind_of_edit(spark):
    """Copies of 100 pictures under each edit; at least nine in ten are found, and nothing else is."""
    vectors = np.random.default_rng(5).normal(size=(100, 64))
    pictures = [np.rint(image_copies.drawn(v)).astype(np.uint8) for v in vectors]
    row = lambda i, x: (i, x.shape[1], x.shape[0], np.ascontiguousarray(np.rint(x).astype(np.uint8)).tobytes())
    ddl = "id long, width int, height int, pixels binary"
    queries = [row(1000 * k + i, edit(p.astype(float))) for k, edit in enumerate(_edits().values()) for i, p in enumerate(pictures)]
    out = image_copies.find_copies(spark.createDataFrame(queries, ddl), spark.createDataFrame([row(i, p) for i, p in enumerate(pictures)], ddl)).collect()
    found = {(r["query_id"], r["match_id"]) for r in out}
    recall = {name: sum((1000 * k + i, i) in found for i in range(100)) / 100 for k, name in enumerate(_edits())}
    assert all(r >= 0.9 for r in recall.values())
    assert all(a % 1000 == b for a, b in found)


def test_copies_equal_brute_force(spark):
    """All pairs of descriptors of 30 pictures and 12 edited ones, some alike."""
    vectors = np.random.default_rng(6).normal(size=(30, 64))
    vectors[10:20] = vectors[:10] + 0.02 * vectors[20:30]
    edits = list(_edits().values())
    images = {i: np.rint(image_copies.drawn(v)).astype(np.uint8) for i, v in enumerate(vectors)}
    queries = {100 + i: np.ascontiguousarray(np.rint(edits[i % len(edits)](images[i].astype(float))).astype(np.uint8)) for i in range(12)}
    described = {i: image_copies.describe(x) for i, x in (images | queries).items()}
    want = set()
    for q in queries:
        x, y, scale, turn, bits = described[q]
        for i in images:
            x2, y2, scale2, turn2, bits2 = described[i]
            far = np.unpackbits(bits[:, None] ^ bits2[None], axis=2).sum(axis=2)
            chunks = lambda b: np.ascontiguousarray(b).view(np.uint32)
            meet = (chunks(bits)[:, None] == chunks(bits2)[None]).any(axis=2) & (far <= image_copies.FAR)
            cells: dict = {}
            for a, b in zip(*np.nonzero(meet)):
                ratio = np.float32(scale2[b]).astype(float) / np.float32(scale[a]).astype(float)
                t = (turn2[b] - turn[a]) % 32
                angle = t * 2 * np.pi / 32
                p = [float(np.float32(v)) for v in (x[a], y[a], x2[b], y2[b])]
                dx = p[2] - (np.cos(angle) * p[0] - np.sin(angle) * p[1]) / ratio
                dy = p[3] - (np.sin(angle) * p[0] + np.cos(angle) * p[1]) / ratio
                for u in (0, 0.5):
                    for v in (0, 0.5):
                        for w in (0, 0.5):
                            for z in (0, 0.5):
                                cells.setdefault((np.floor(np.rint(np.log2(ratio) * 4) / 2 + z), z, np.floor(t / 2 + w) % 16, w, np.floor(dx / 6 + u), u, np.floor(dy / 6 + v), v), set()).add(a)
            if cells and max(map(len, cells.values())) >= min(5, -(-len(x) // 2)):
                want.add((q, i))
    ddl = "id long, width int, height int, pixels binary"
    rows = lambda d: spark.createDataFrame([(i, x.shape[1], x.shape[0], x.tobytes()) for i, x in d.items()], ddl)
    got = {(r["query_id"], r["match_id"]) for r in image_copies.find_copies(rows(queries), rows(images)).collect()}
    assert got == want and len(want) > 15


def test_corners_that_meet_in_several_tables_are_joined_once(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 63), 1 << 63, 4)
    rows = [[int(x) for x in base]]
    for bits in ([0], [40, 70], [1, 33, 65, 97, 129, 161, 193], [b * 32 for b in range(8)]):  # chunks that differ
        row = [int(x) & (1 << 64) - 1 for x in base]
        for b in bits:
            row[b // 64] ^= 1 << b % 64
        rows.append([x - (1 << 64) if x >> 63 else x for x in row])
    images = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "image long, d0 long, d1 long, d2 long, d3 long")
    queries = image_copies._keys(images.filter("image = 0")).select("key", *[F.col(f"d{k}").alias(f"q_d{k}") for k in range(4)])
    met = image_copies._keys(images).join(queries, "key").filter(F.shiftright("key", 32) == image_copies._first_table())
    assert sorted(r["image"] for r in met.collect()) == [0, 1, 2, 3]
