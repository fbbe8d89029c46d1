"""Operators 1, 5, 6, 7 and 8 against brute force."""

import base64
import hashlib
import io
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from readloom.llm import bpe, decontaminate, sharding, urls, warc
from readloom.llm.queries import QUERIES, URL_RULES

DOCS = [
    (1, "plain text of a few words", 7),
    (2, None, 7),
    (3, "", 7),
    (4, "plain text of a few words", 7),
    (4, "plain text of a few words", 7),
    (None, "no id", 7),
    (6, "x" * 50_000 + " é " + "long " * 3000, 7),
    (7, "\x00 \n ...", 7),
]
SCHEMA = "doc_id bigint, text string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(("~" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_shards_follow_the_published_walk(docs, n):
    rows = sharding.shard(docs, n).collect()
    assert len(rows) == len(DOCS)
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == jump(key_of(r.doc_id), n)
        assert r.grown_shard == jump(key_of(r.doc_id), n + 1)
        assert r.grown_shard in (r.shard, n)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in DOCS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want


def test_shards_of_whole_table(spark, sf):
    rows = QUERIES["op1_sharding"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.shard == jump(key_of(r.doc_id), 40) and r.law == "key" for r in rows)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert sharding.shard(none, 3).count() == 0
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.mark(none, items).count() == 0
    assert decontaminate.mark(docs, items.where("false")).where("bd_n_hit > 0").count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(pages).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in lengths:
                if (own := windows.get(tuple(w[k : k + n]))) and k + n <= len(w):
                    hit.update(range(k, k + n))
                    found |= own
        joined = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (10, "one two three four five six seven eight nine ten eleven twelve"),
    (11, "Two THREE four five six seven eight nine ten eleven"),
    (9, "short item"),
    (8, None),
    (7, " ... "),
    (6, "short item"),
    (5, "é ü ñ"),
]
TEXTS = [
    (1, "zero ONE two, three four five six seven eight nine ten eleven twelve thirteen"),
    (2, "a short item and short-item short item"),
    (3, "shortitem"),
    (4, None),
    (5, "five six seven eight nine ten eleven twelve"),
    (6, "short"),
    (7, "item é ü ñ"),
    (8, "É Ü Ñ é_ü-ñ"),
    (2, "short item"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_decontamination_of_cases(spark, block_bytes):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    marked = decontaminate.mark(docs, items, block_bytes=block_bytes)
    got = sorted(((r.doc_id, r.bd_n_words, r.bd_n_hit, len(r.bd_items), hashlib.sha256(",".join(sorted(map(str, r.bd_items))).encode()).hexdigest(), r.bd_n_hit > 0) for r in marked.collect()), key=str)
    assert got == brute(TEXTS, ITEMS)
    if block_bytes > 64:
        spans = {(s.item_id, s.doc_word, s.n_words) for r in marked.where("doc_id = 1").collect() for s in r.bd_spans}
        assert spans == {(10, 1, 12), (11, 2, 10)}
    kept = decontaminate.decontaminate(docs, items, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(TEXTS, ITEMS) if not r[5])


def test_decontamination_of_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_decontamination"](spark, sf).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


def test_warc_round_trip(spark):
    big = "<p>" + "word " * 200_000
    rows = [(3, "http://a/", big), (1, None, big), (2, "u\r\nx: y", None), (5, "v", ""), (4, "é", "unique"), (None, "w", big), (4, "é", "unique")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).drop("url").collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = [(i, len((t or "").encode()), digest(t), *(("response", None) if i == least[t or ""] else ("revisit", least[t or ""]))) for i, _, t in rows]
    assert got == sorted(want, key=str)


def test_warc_with_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "_HOT", 10)
    rows = [(i, "u", "hot" if i % 3 else "warm" if i % 30 else f"own {i}") for i in range(1, 301)] + [(None, "u", "hot"), (1, "u", "hot")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "record_type", "refers_to").collect()
    least = {"hot": 1, "warm": 3}
    want = [(i, *(("response", None) if least.get(t, i) == i else ("revisit", least[t]))) for i, _, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_revisits_name_a_record():
    first = next(warc.read_records(io.BytesIO(warc.make_record(1, "u", b"x", None, "d"))))[0]
    again = next(warc.read_records(io.BytesIO(warc.make_record(2, "u", b"x", 1, "d"))))[0]
    assert again["warc-refers-to"] == first["warc-record-id"] != again["warc-record-id"]


def test_warc_reader_refuses_damage():
    whole = warc.make_record(1, "u", b"payload" * 100, None, "d") + warc.make_record(2, "u", b"payload" * 100, 1, "d")
    assert [f["warc-type"] for f, _ in warc.read_records(io.BytesIO(whole))] == ["response", "revisit"]
    plain = zlib.decompress(warc.make_record(1, "u", b"payload", None, "d"), 31)
    pack = lambda x: (lambda z: z.compress(x) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (whole[:-3], whole[:50] + b"?" + whole[51:], b"none", pack(plain.replace(b"payload\r\n", b"payl0ad\r\n")), pack(plain[:-1]), pack(b"x" + plain)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path):
    fits = []
    for action, rule in URL_RULES:
        own, tail = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/123", "http://example.org", "http://xexample.org/en/1", "http://com/de/",
    "http://x.com/fr/9?u=http://y.com/de/", "no scheme", None, "", "://", "http:///p", "ftp://casinowin.net/x#f", "http://É.com/de/a",
    "http://a.com?x/de/", "http://" + "ab" * 3000 + ".com/" + "pills" * 2000, "http://dailyscience.net/",
]


def test_url_rules_and_words(spark):
    import public_tokenizers as tokenizers

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge_urls(df, URL_RULES, tokenizers.path("word_bpe_49k.json")).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = split_url(url)
        rule, action = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (action or ("block" if got[i].block_score > 0.5 else "allow"))
    assert got[11].verdict == "block" and got[15].verdict == "allow"
    words = urls.Words(tokenizers.path("word_bpe_49k.json"))
    assert words.split("cheappills") == ["cheap", "pills"]
    assert words.split("") == []


def test_viterbi_is_the_best_split():
    import public_tokenizers as tokenizers

    words = urls.Words(tokenizers.path("word_bpe_49k.json"))

    def score(parts):
        return sum(words.log_p.get(p, words.letter * len(p)) for p in parts)

    def all_splits(s):
        if not s:
            yield []
        for i in range(1, len(s) + 1):
            for rest in all_splits(s[i:]):
                yield [s[:i], *rest]

    for name in ("freebets", "thething", "xqzpills", "a"):
        best = max(score(p) for p in all_splits(name))
        assert abs(score(words.split(name)) - best) < 1e-9


def reference_encoding():
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, docs):
    path, pattern, library = reference_encoding()
    got = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    want = sorted(np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes() for _, t, _ in DOCS)
    assert sorted(bytes(r.ids) for r in got) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _ in DOCS)


def test_bpe_in_one_pass_and_in_two(spark, docs):
    import public_tokenizers as tokenizers

    own = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (3, "é 語 " * 1000), (None, "x" * 5000)], "doc_id bigint, text string")
    one, two = bpe.round_trip(df, *own), bpe.decode(bpe.encode(df, *own), *own)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str) and bpe.round_trip(df.where("false"), *own).count() == 0
    assert all(bytes(r.decoded).decode() == (t or "") for r, t in zip(one.where("doc_id = 1").collect(), ["some text"]))


def test_bpe_of_odd_texts():
    import random

    path, pattern, library = reference_encoding()
    own = bpe.encoder(path, pattern)
    rnd = random.Random(5)
    texts = ["aaaa" * 40, "日本語 １２３ ½ x²\x85\xa0 \x1c it's I'LL we've", "\n\n \t x", "’s “x” — …", "привет 'sдом", "ⅷ 1⁄2 ǅ"]
    texts += ["".join(rnd.choice("abc ABC'\n\tst12 éñüß½²日 \xa0\x85._-!—“") for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    texts += ["".join(chr(rnd.randint(0, 0xD7FF)) for _ in range(30)) for _ in range(100)]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids == np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
        assert ids == own.encode(text)
        assert bpe.decode_ids(own.vocabulary, ids) == text.encode()
    with pytest.raises(ValueError):
        bpe.decode_ids(own.vocabulary, np.array([own.vocabulary.size], dtype="<u4").tobytes())


def test_bpe_of_whole_table(spark, sf):
    _, _, library = reference_encoding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
