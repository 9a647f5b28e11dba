from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from bomlens.llm import ann_forest as A
from bomlens.llm import fingerprints as P
from bomlens.llm import template_removal as T

from ..conftest import SMALL


def text(source, template=()):
    root = T.parse(source)
    T.settle(root)
    return T.main_text(root, set(template))


@pytest.mark.parametrize("source,want", [
    ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a  b\n c<p>d<br>e</p>", "a b c\nd e"),
    ("<nav>menu</nav><article><h1>T</h1><p>x<script>1<2</script></p><div class='ad'>buy</div><section class=comments><p>no</p></section></article><footer>f</footer>", "T\nx"),
    ("<body><div id=content><p>one</p><ul><li>a<li>b</ul></div><div class=sidebar>s</div>", "one\na\nb"),
    ("<title>t</title><p>&lt;b&gt; &eacute;&#233;&nbsp;x</p><!-- c --><style>p{}</style>", "<b> éé x"),
    ("<p>a < b and <b>c</p><p unclosed", "a < b and c\n<p unclosed"),
])
def test_main_text(source, want):
    assert text(source) == want


def test_template_subtrees_go(spark):
    junk = "<div class=x><p>Welcome to our site</p><ul><li>a</li></ul></div>"
    pages = [(i, f"http://h.org/{i}", f"<body>{junk}<div><p>story {i} {'w ' * 80}</p></div></body>") for i in range(12)]
    pages += [(100, None, None), (101, "http://h.org/e", ""), (102, "http://other.org/", f"<body>{junk}<div><p>alone {'w ' * 80}</p></div></body>"), (0, "http://h.org/0", pages[0][2])]
    rows = [(*p, "t", "x", 1) for p in pages]
    got = T.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, keys int").repartition(3)).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 16
    assert all(by[i] == f"story {i} {'w ' * 80}".strip() for i in range(12))
    assert by[100] == by[101] == ""
    assert by[102].startswith("Welcome to our site\na\nalone")
    assert T.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_are_no_template(spark):
    page = "<body><div><p>" + "same story " * 30 + "</p></div></body>"
    got = T.extract(spark.createDataFrame([(i, "http://h.org/x", page) for i in range(20)], "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {("same story " * 30).strip()}


def unique(r, n):
    return " ".join(f"w{r.integers(10**9)}" for _ in range(n))


@pytest.mark.parametrize("build", [
    lambda w: ("<nav>menu</nav><h1>{}</h1><div class=a><p>{}</p></div><div class=b><p>{}</p></div>", [w(5), w(60), w(40)], None),
    lambda w: ("<div class=s>{}</div><article><h1>{}</h1><p>{}</p></article>", [w(100), w(5), w(30)], None),
    lambda w: ("<p class=lead>{}</p><div class=story><p>{}</p><p>{}</p></div>", [w(20), w(80), w(60)], None),
    lambda w: ("<header><a href=/>Home</a><h1>{}</h1></header><div><p>{}</p></div>", [w(6), w(70)], None),
    lambda w: ("<header><h1>{}</h1><nav>menu</nav></header><section><p>{}</p></section><section><p>{}</p></section>", [w(6), w(30), w(70)], None),
    lambda w: ("<main><p>{}</p><article><h1>{}</h1></article></main>", [w(40), w(5)], None),
    lambda w: ("<article><p>{}</p></article><article><p>{}</p></article><article><p>{}</p></article>", [w(60), w(50), w(10)], None),
    lambda w: ("<div class=sidebar>{}</div><article><p>{}</p><aside>{}</aside><section class='reader comments'>{}</section></article>", [w(9), w(30), w(9), w(9)], [1]),
])
def test_unique_text_is_kept_and_recurring_subtrees_go(spark, build):
    """On hosts of twelve pages and of two; ``kept`` names the parts that are article text, all if it is None."""
    r = np.random.default_rng(3)
    junk = "<div class=zz><p>Welcome to our site</p><ul><li>a</li></ul></div>"
    pages, want = [], {}
    for host, n in (("many", 12), ("few", 2)):
        for i in range(n):
            html, words, kept = build(lambda k: unique(r, k))
            page = len(pages)
            pages.append((page, f"http://{host}.org/{i}", f"<body>{junk if host == 'many' else ''}{html.format(*words)}</body>"))
            want[page] = "\n".join(words if kept is None else [words[k] for k in kept])
    got = T.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert {x["page_id"]: x["text"] for x in got} == want


def test_texts_are_those_of_a_plain_subtree_count(spark):
    """Hosts with recurring frames under names of no list, paragraphs that recur and quotes inside articles, against dictionaries."""
    r = np.random.default_rng(4)
    words = [f"word{k}" for k in range(400)]
    say = lambda n: " ".join(r.choice(words, n))
    pages = []
    for h in range(6):
        frames = [f"<div class=q{'xyz'[k]}><p>{say(6)}</p><span>{say(3)}</span></div>" for k in range(3)]
        lines, quote = [f"<p>{say(5)}</p>" for _ in range(2)], f"<p>{say(8)}</p>"
        for i in range(int(r.integers(1, 16))):
            body = "".join(f"<p>{say(int(r.integers(5, 30)))}</p>" for _ in range(3)) + (quote if r.random() < 0.8 else "")
            body = f"<article>{body}{frames[0]}</article>" if h % 2 else f"<div class=text>{body}</div>"
            some = "".join(f for f in frames[1:] if r.random() < 0.6) + "".join(x for x, p in zip(lines, (0.9, 0.2)) if r.random() < p)
            pages.append((len(pages), f"https://h{h}.org/{i}", f"<html><body>{frames[0]}{some}{body}<footer>{say(4)}</footer></body></html>"))
    host: dict = {}
    for _, url, source in pages:
        root = T.parse(source)
        T.settle(root)
        article = "|".join(T.main_text(c) for c in T.articles(root)) or source
        found = host.setdefault(url.split("/")[2], {}).setdefault(article, {})
        for x in T.blocks(root):
            if x.size:
                found[ast(x)] = (x.size, root.size, x.tag in T.PLAIN)
    changed = 0
    got = {x["page_id"]: x["text"] for x in T.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    for page, url, source in pages:
        prints = host[url.split("/")[2]]
        root = T.parse(source)
        T.settle(root)
        gone = set()
        for x in T.blocks(root):
            at = [f[ast(x)] for f in prints.values() if x.size and ast(x) in f]
            often = len(at) >= len(prints) / 2 if x.tag in T.PLAIN else len(at) >= len(prints) ** 0.5 / 2
            if len(at) >= 3 and often and 2 * sum(a for a, _, _ in at) < sum(b for _, b, _ in at):
                gone.add(x.key)
        assert got[page] == T.main_text(root, gone)
        changed += got[page] != T.main_text(root)
    assert changed > 10


def ast(node):
    """A subtree as text: tags, names and words."""
    inner = " ".join(ast(c) if isinstance(c, T.Node) else " ".join(c.split()) for c in node.children)
    return f"({node.tag} {T.names(node)}>{inner})"


def test_articles_of_the_tables(spark):
    got = T.op4_template_removal(spark, SMALL).collect()
    assert len(got) == 50 and all(r["n_chars"] == len(r["text"]) > 0 for r in got)


def tone(notes, rate=11025, seconds=1.0):
    t = np.arange(int(rate * seconds)) / rate
    return np.concatenate([np.sin(2 * np.pi * f * t) for f in notes])


def test_fingerprints_align_shifted_recordings():
    rng = np.random.default_rng(0)
    song, other = (tone(220 * 2 ** (rng.integers(0, 24, 30) / 12)) for _ in range(2))
    a, b, c = P.fingerprint(song), P.fingerprint(song[1365 * 10 :] + rng.normal(0, 0.01, len(song) - 13650)), P.fingerprint(other)
    offset, error, n = P.align(a, b)
    assert offset == 10 and error < 0.1 and n == len(b)
    assert P.same(a, b) and not P.same(a, c)
    assert P.align(a, a)[:2] == (0, 0.0) and P.align(a, np.zeros(0, np.uint32)) == (0, 1.0, 0)
    assert len(P.fingerprint(np.zeros(10))) == 0


def test_matching_recordings(spark):
    rng = np.random.default_rng(1)
    p = P.Params(rate=1000, frame=128, hop=16, low_hz=8.0, high_hz=500.0)
    wave = lambda: ((tone(60 * 2 ** (rng.integers(0, 24, 12) / 12), 1000, 0.4) * 100) + 128).astype(np.uint8).tobytes()
    x, y = wave(), wave()
    media = [(0, x), (1, y), (2, x), (3, x[160:]), (4, None), (5, b""), (6, b"short")]
    rows = P.fingerprints(spark.createDataFrame(media, "rec long, data binary"), p)
    got = {r["rec"]: r for r in P.matches(rows).collect()}
    assert {k: r["match"] for k, r in got.items()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6}
    assert abs(got[3]["offset"]) == 10 and got[4]["prints"] == b""
    assert P.matches(rows.limit(0)).count() == 0


def test_matches_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)

    def noisy(x, kept):
        """Two bits of each integer flip, but of the one at ``kept``."""
        y = x.copy()
        for i in range(len(x)):
            if i != kept:
                y[i] ^= np.uint32(1) << np.uint32(rng.integers(0, 16)) | np.uint32(1) << np.uint32(rng.integers(16, 32))
        return y

    prints = [new(30)]
    for i in range(8):
        song = new(40)
        prints += [song, noisy(song, i), np.concatenate([new(5), noisy(song, i + 9)])]
        # The first recording of the list holds what they share, and aligns with none of them.
        prints[0][[3 * i, 3 * i + 1]] = song[i], song[i + 9]
    prints += [prints[4].copy(), new(3), new(0)]
    match = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a + 1, len(prints)):
            if len(prints[a]) and (P.same(prints[a], prints[b]) or np.array_equal(prints[a], prints[b])):
                match = [min(match[a], match[b]) if m in (match[a], match[b]) else m for m in match]
    assert match[0] == 0 and sum(m < i for i, m in enumerate(match)) == 17
    got = P.matches(spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in enumerate(prints)], "rec long, prints binary")).collect()
    assert {r["rec"]: r["match"] for r in got} == dict(enumerate(match))
    assert all((r["bit_error"] is None) == (r["match"] == r["rec"]) for r in got)
    assert {r["rec"]: r["offset"] for r in got}[3] == -5


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    rows = [(i, v.tolist(), "x", 0.5) for i, v in enumerate(x)]
    odd = [(10_000, None, "x", 0.0), (10_001, [0.0] * 16, "x", 0.0), (10_002, [float("nan")] * 16, "x", 0.0), (10_003, [1.0, None] + [0.0] * 14, "x", 0.0), (10_004, [1.0] * 3, "x", 0.0), (None, [1.0] * 16, "x", 0.0), (0, x[0].tolist(), "x", 0.5), (10_020, x[40].tolist(), "x", 0.1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string, score double")
    got = A.search(table, table.filter("vec_id % 20 = 0")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(3000), 10_020])
    v = np.concatenate([x, x[40:41]])
    assert set(by) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in by.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s[ids == i][0] - w) < 1e-9 for _, i, w in found)
        hits += len(best & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(by)
    assert A.search(table.limit(0), table.limit(0)).count() == 0
    assert A.search(table.filter("vec_id < 3"), table.filter("vec_id = 0")).count() == 2


def test_near_neighbours_take_few_candidates():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((100, 32)), 40, axis=0) + rng.standard_normal((4000, 32)) * 0.3
    x *= rng.uniform(0.9, 1.1, (4000, 1))  # the largest inner product isn't the least angle
    f, hits, scored = A.Forest(np.arange(4000), x), 0, 0
    q = np.arange(0, 4000, 80)
    for i, (found, scores, n) in zip(q, f.search(x[q], q, 20, 20)):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(found))
        scored += n
    assert hits >= 0.9 * 20 * len(q) and scored < 0.1 * 4000 * len(q)


def test_copies_are_in_the_order_of_their_ids_across_shards(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_ROWS", 100)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 24))
    x[rng.permutation(400)[:150]] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [1.0, float(i + 1)]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got: dict = {}
    for r in A.search(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    copies = [i for i in range(400) if (x[i] == x[7]).all()]
    asked = [i for i in copies if i % 20 == 0]
    assert asked and all([v for v, _ in got[q]] == [c for c in copies if c != q][:20] and len({w for _, w in got[q]}) == 1 for q in asked)
    assert [v for v, _ in got[1000]] == list(range(1029, 1009, -1)) and got[1000][0][1] == 31.0


def test_query_of_recordings_equals_brute_force(spark, tmp_path):
    """Turns with shifted and noisy copies, nulls, empty and very long texts, repeated rows and clashing columns."""
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(map(chr, rng.integers(32, 127, n)))
    texts = [letters(700) for _ in range(60)]
    texts += [t[160:] for t in texts[:15]] + [t[:300] + "~~" + t[302:] for t in texts[15:30]] + [letters(32) + t for t in texts[30:45]] + texts[45:50]
    texts += [None, "", "short", letters(60_000)]
    rows = [(i // 4, i % 4, t, 1, "x", 0.5) for i, t in enumerate(texts)] + [(None, None, texts[0], 1, "x", 0.5)] + [(0, 0, texts[0], 1, "x", 0.5)] * 2
    spark.createDataFrame(rows, "conv_id long, turn int, text string, rec int, prints string, match double").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = P.op3_chroma_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    p = P.Params(rate=1000, frame=128, hop=16, low_hz=8.0, high_hz=500.0)
    recs = {(r["conv_id"], r["turn"]): r["rec"] for r in got}
    prints = {recs[c, t]: P.fingerprint(P.decode((x or "").encode()), p) for c, t, x, *_ in rows}
    label = {r: r for r in prints}
    for a in prints:
        for b in prints:
            if a < b and len(prints[a]) and len(prints[b]) and (np.array_equal(prints[a], prints[b]) or P.same(prints[a], prints[b])):
                old = {label[a], label[b]}
                label |= {r: min(old) for r, m in label.items() if m in old}
    assert sum(r != m for r, m in label.items()) >= 20
    assert {r["rec"]: (r["match"], r["n_prints"]) for r in got} == {r: (label[r], len(prints[r])) for r in prints}
    spark.createDataFrame([], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert P.op3_chroma_fingerprints(spark, f"{tmp_path}/none").count() == 0


def story(i, words=60):
    rng = np.random.default_rng(i)
    return " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(words))


def test_blocks_of_meaningless_names_go_only_if_their_words_recur(spark):
    """Tags and classes that say nothing: what differs on every page stays, what recurs goes, one rule for large and small hosts."""
    page = lambda i: f"<body><div class=q{i % 3}x><ul><li>{story(7, 3)}<li>{story(8, 3)}</ul></div><div class=zz><div class=k><p>{story(i)}</p><div class=w>{story(3000 + i, 8)}</div><p>{story(4000 + i, 20)}</div></div><div class=v>{story(9, 6)}</div>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(12)] + [(99, "http://h.org/none", None), (98, "http://one.org/", page(98))]
    got = {r["page_id"]: r["text"] for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    own = lambda i: [story(i), story(3000 + i, 8), story(4000 + i, 20)]
    assert all(got[i] == "\n".join(own(i)) for i in range(12))
    assert got[99] == "" and got[98] == "\n".join([story(7, 3), story(8, 3), *own(98), story(9, 6)])


def test_several_articles_of_a_page_stay(spark):
    page = lambda i: f"<div class=a>{story(100 + i, 4)}</div>" + "".join(f"<article><p>{story(10 * i + k, 30)}</p></article>" for k in range(1 + i % 3))
    rows = [(i, f"http://h.org/{i}", f"<body>{page(i)}<footer>{story(300 + i, 5)}</footer>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join([story(100 + i, 4), *(story(10 * i + k, 30) for k in range(1 + i % 3))]) for i in range(9))


def test_very_long_and_deep_pages(spark):
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "http://a.org", deep), (2, "http://a.org", long), (None, None, "<p>x"), (4, "no url", "<nav>only a menu</nav>")]
    got = {r["page_id"]: r["text"] for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "core" and got[2].count("\n") == 29_999 and got[None] == "x" and got[4] == ""


def test_files_are_few_however_many_shuffle_partitions(spark, monkeypatch):
    """Hashes are written by the tasks that read the pages and deleted at last; hosts have one table."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    files = lambda: set(folder.rglob("part-*.parquet"))
    before, gone = files(), []
    monkeypatch.setattr(T, "discard", gone.append, raising=False)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    former = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        page = lambda i: f"<body><div class=q><p>{story(7 + i % 2, 4)}</p></div><div class=z><p>{story(1000 + i)}</p></div>"
        rows = [(i, f"http://h{i % 2}.org/{i}", page(i)) for i in range(60)]
        got = {r["page_id"]: r["text"] for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)
    assert got == {i: story(1000 + i) for i in range(60)}
    assert len(files() - before) <= 3 + 3 and len(gone) == 1  # Spark writes a file for the first partition, even an empty one
