"""Operators 2 and 9 and the pipeline against brute force."""

import hashlib
import random
import re
import sys
import time
from collections import defaultdict
from html import unescape

import numpy as np
import pytest

from readloom.llm import graph, html, neardup, words
from readloom.llm.queries import QUERIES


def article_of(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    lines = re.sub(r"<[^>]*(>|\Z)", "\n", body[1] if body else "").split("\n")
    return " ".join(" ".join(unescape(x) for x in lines).split())


def test_text_of_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op2_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == article_of(pages[r.page_id]) for r in rows) >= 0.99 * len(rows)


def test_trees_on_held_out_templates():
    model, rnd, wrong, total = html.train(), random.Random(4242), 0, 0
    for _ in range(150):
        rows, labels = html.labelled_nodes(page := html.labelled_page(rnd))
        nodes, _ = html.parse(page.replace(" data-m", ""))
        kept = html.decode(nodes, model.probability(np.array(rows)))
        wrong += sum(a != b and n.own > 0 for a, b, n in zip(kept, labels, nodes))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_decoding_is_consistent_and_best():
    rnd = random.Random(2)
    for _ in range(60):
        nodes = [html.Node("body", None, frozenset())]
        for _ in range(rnd.randint(0, 7)):
            nodes.append(html.Node("div", rnd.choice(nodes), frozenset()))
        p = np.array([rnd.uniform(0.01, 0.99) for _ in nodes])
        number = {id(n): i for i, n in enumerate(nodes)}
        up = [None if n.parent is None else number[id(n.parent)] for n in nodes]
        order = sorted(range(len(nodes)), key=lambda i: nodes[i].depth)
        nodes = [nodes[i] for i in order]
        p, up = p[order], [None if up[i] is None else order.index(up[i]) for i in order]
        kept = html.decode(nodes, p)
        assert all(u is None or kept[u] or not k for k, u in zip(kept, up))

        def score(bits):
            return sum(np.log(q if b else 1 - q) for b, q in zip(bits, p))

        options = [[bool(m >> i & 1) for i in range(len(nodes))] for m in range(1 << len(nodes))]
        legal = [b for b in options if all(u is None or b[u] or not k for k, u in zip(b, up))]
        assert abs(score(kept) - max(map(score, legal))) < 1e-9


PAGES = [
    (1, None), (2, ""), (3, "no markup at all"), (4, "<p"), (5, "<article><p>a &lt; b&nbsp;&amp c<br>d<i>e</i>f</p><script>x</script><p>g"),
    (6, "<div>" * 3000 + "deep"), (7, "<!-- open <p>x</p>"), (8, "<p>" + "long words here. " * 100_000), (1, None),
    (9, "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><article><h1>Title</h1><p>Some text, of the article itself. It goes on.</article><div class='comments'><p>Nice post, thanks a lot.</p></div>"),
]


def test_text_of_odd_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, html string").selectExpr("*", "'u' as url", "1 as text")
    rows = html.extract(df).collect()
    assert len(rows) == len(PAGES)
    by_id = {r.page_id: r.text for r in rows}
    assert by_id[1] == "" and by_id[2] == "" and by_id[4] == ""
    assert by_id[5] in ("a < b & c def g",)
    assert by_id[9] == "Title Some text, of the article itself. It goes on."
    assert html.extract(df.where("false")).count() == 0


def test_long_pages_take_linear_time():
    model = html.train()
    for many in ("<article>" + "<p>Some words, here.</p>" * 20_000, "<article>" + "<b>x <i>y" * 20_000 + "</u></i>" * 20_000, "<div>x" * 20_000 + "</p>" * 20_000, "<p a='" * 20_000, "<b>" * 20_000 + "<p>" * 20_000):
        begin = time.process_time()
        html.extract_all(model, [many])
        assert time.process_time() - begin < 20


def test_markup_stays_out():
    model = html.train()
    page = """<body><article><h1>T</h1><p title="a > b">Hello there, my friend.</p><svg/><p data-x='<i>'>More text is here.</p><title-card>And a card.</title-card><p it's>And more, again.<svg><text>no</text></svg></article>"""
    assert html.extract_all(model, [page]) == ["T Hello there, my friend. More text is here. And a card. And more, again."]


FOREIGN = {
    "table": "<body><table><tr><td class=menu><a href=/>Home</a><br><a href=/b>News</a></td><td><h2>{title}</h2><p>{a}</p><p>{b}</p></td></tr></table><div class=foot>All rights reserved by us</div></body>",
    "divs": "<body><div id=top-nav><a href=/>Start</a> <a href=/x>More</a></div><div id=content><h1>{title}</h1><div>{a}</div><div>{b}</div></div><div class=sidebar><h3>Popular</h3><ul><li><a href=/1>One thing</a><li><a href=/2>Two things</a></ul></div></body>",
    "main": "<body><header><h2>Site</h2><nav><a href=/>Home</a></nav></header><main><section><h1>{title}</h1><p>{a}</p><blockquote><p>{b}</p></blockquote></section></main><div id=disqus_thread class=comments><p>I do not agree, sorry.</p></div><footer><p>Imprint and contact</p></footer></body>",
    "post": "<body><ul class=breadcrumb><li><a href=/>Home</a></li><li><a href=/c>Cats</a></li></ul><div class='post hentry'><h1>{title}</h1><div class=entry-content><p>{a}</p><h2>Part</h2><p>{b}</p></div><div class=share-buttons><a href=/t>Tweet</a><a href=/f>Share</a></div></div><div class=cookie-notice><p>We use cookies on this site.</p></div></body>",
}


def foreign_shares(model, pages=100):
    """Share of right pages of each shape."""
    out = {}
    for name, shape in FOREIGN.items():
        rnd = random.Random(name)
        right = 0
        for _ in range(pages):
            title, a, b = html._sentence(rnd, 2, 7), html._prose(rnd, 2, 7), html._prose(rnd, 2, 7)
            want = " ".join([title, a, *(["Part"] if name == "post" else []), b])
            right += html.extract_all(model, [shape.format(title=title, a=a, b=b)]) == [want]
        out[name] = right / pages
    return out


def test_shapes_unlike_the_templates():
    assert np.mean(list(foreign_shares(html.train()).values())) >= 0.5


BLANK = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, size):
    w = BLANK.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, size):
    """id -> (set size, smallest id reachable), from an index of every shingle."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                if j < i:
                    shared[j] += 1
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_groups_of_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_groups(docs, 4)
    rows = QUERIES["op9_near_duplicates"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_groups_of_cases(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randint(0, 999)}" for _ in range(120)]
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "One TWO"), (10, "one two three"), (11, "x " * 30_000), (12, "x x x x x")]
    for i in range(300):
        w = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 5, 6, 8))):
            w[rnd.randrange(len(w))] = f"m{rnd.randint(0, 9999)}"
        rows.append((100 + i, " ".join(w)))
    want = brute_groups(rows, 4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'k' as key")
    assert {r.id: (r.n, r.component) for r in neardup.group(df, size=4).collect()} == want
    kept = neardup.deduplicate(df, size=4)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert neardup.group(df.where("false")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "p q r s t"), (2, "a b c d e"), (3, "other words stand in here")]
    got = sorted(((r.id, r.component) for r in neardup.group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 1), (3, 3)], key=str)


def test_rows_of_one_id_leave_by_their_own_text(spark):
    x, y = "some text that is here twice in the table", "another text that nobody else has at all"
    df = spark.createDataFrame([(1, x), (2, y), (2, x), (3, None), (3, None)], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in neardup.deduplicate(df).collect()), key=str) == [(1, x), (2, y), (3, None), (3, None)]


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = ["ab cd " * 40, "", "x" * 300 + " y", "one"]
    data = [t.encode() for t in texts]
    whole = words.WordText(b"".join(data), [len(x) for x in data], words.NOT_BLANK)
    monkeypatch.setattr(words, "_PIECE", 16)
    cut = words.WordText(b"".join(data), [len(x) for x in data], words.NOT_BLANK)
    assert (whole.hash == cut.hash).all() and (whole.first == cut.first).all()


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "byte_bpe"]
    sf = "/root/testdata/sf0.01"
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_native_and_exact import brute, reference_encoding

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    left = [(i, t) for i, t in docs if re.search(r"[^\W\d_]", t)]
    groups = brute_groups(left, 5)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute(left, items) if r[5]}
    _, _, library = reference_encoding()
    want = {}
    for i, t in left:
        if i not in dirty:
            ids = np.array(library.encode_ordinary(t), dtype="<u4").tobytes()
            want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(docs)


@pytest.mark.parametrize("size", [4, 5])
def test_short_text_alone_in_a_batch(size):
    for n in range(size + 2):
        text = " ".join("abcdefg"[:n])
        doc, found = words.shingles(words.WordText(text.encode(), [len(text)], words.NOT_BLANK), size)
        # The same as beside another text.
        both = text + "u v w x y z"
        doc_2, found_2 = words.shingles(words.WordText(both.encode(), [len(text), len(both) - len(text)], words.NOT_BLANK), size)
        assert doc.tolist() == [0] * len(words.shingle_set(text, size)) and found.tolist() == found_2[doc_2 == 0].tolist()
