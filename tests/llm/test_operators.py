"""The text operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import io
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanloom.llm import components, decontaminate, exact_dedup, html_text, mixing, quality, simhash, substring_dedup, toxicity, url_filter, warc
from scanloom.llm.common import shared_dir

RNG = random.Random(3)
VOCABULARY = [f"w{k}" for k in range(40)] + ["Über", "naïve", "LOUD", "x"]
SCHEMA = "doc_id bigint, text string, lang string, source string, copies int, sha int, row string"


def words(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def rows_of(texts, sources=("a", "b", None)):
    return [(k, t, "en", sources[k % len(sources)], 7, 8, "r") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    base = [words(RNG.choice([0, 1, 3, 12, 40, 90])) for _ in range(60)]
    base += [None, "", "   ", "\t\n", "ABC def", "abc DEF", base[5].upper(), base[5], base[7] + " tail", words(3000)]
    return base + base[:10]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts) + [rows_of(texts)[3], (None, "a null id", "en", "a", 1, 1, "r"), (None, None, None, None, None, None, None)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# Decontamination

def brute_contamination(text, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    w, hit, found = find(text), set(), set()
    for name, item in items:
        v = find(item)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == v[k : k + n]:
                    hit.update(range(s, s + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("window", [10, 3])
def test_decontamination(spark, docs, texts, window):
    long = texts[69]
    items = [(k, t) for k, t in enumerate([" ".join(long.split()[50:75]), texts[4], None, "", "abc", "w1 w2", texts[8], "Über NAÏVE", "nothing here"])]
    benchmark = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id bigint, text string, doc_id int")
    for r in decontaminate.contamination(docs, benchmark, window).join(docs.select(F.col("doc_id").alias("i"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_hit"], r["items"]) == brute_contamination(r["text"], items, window)
            assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]
    kept = decontaminate.drop_contaminated(docs, benchmark, window)
    assert kept.columns == docs.columns and kept.filter("doc_id = 69").isEmpty() and not kept.filter("doc_id = 62").isEmpty()


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_proximity(spark):
    docs = spark.createDataFrame([(0, "one two x three four"), (1, "one x y z two three four"), (2, "four three two one")], "doc_id bigint, text string")
    item = spark.createDataFrame([(0, "one two three four")], "item_id bigint, text string")
    hit = lambda slop: {r["doc_id"] for r in decontaminate.contamination(docs, item, slop=slop).filter("n_hit > 0").collect()}
    assert hit(0) == set() and hit(1) == {0} and hit(3) == {0, 1} and hit(6) == {0, 1, 2}


def test_terms_that_stray_stay_in_their_document(spark):
    docs = spark.createDataFrame([(1, "q q q x"), (2, "a z x q"), (3, "x"), (4, "a")], "doc_id bigint, text string").coalesce(1)
    item = spark.createDataFrame([(0, "a x")], "item_id bigint, text string")
    for slop in (1, 2, 3, 4, 9):
        assert [r["doc_id"] for r in decontaminate.contamination(docs, item, slop=slop).filter("n_hit > 0").collect()] == [2]


def test_contaminated_rows_go_by_text(spark):
    df = spark.createDataFrame([(None, "bad words here"), (None, "fine"), (1, "bad words here"), (1, "fine too"), (1, "bad words here"), (2, None), (3, "")], "doc_id bigint, text string")
    item = spark.createDataFrame([(0, "bad words here")], "item_id bigint, text string")
    assert sorted(map(str, decontaminate.drop_contaminated(df, item).collect())) == sorted(map(str, df.filter("text is null or text not like 'bad%'").collect()))


# WARC

PAGES = [(0, "http://a.b/c d", "<p>one</p>"), (1, None, None), (2, "http://x", ""), (3, "u", "<p>one</p>"), (4, "u", "x" * 70_000), (5, "u", "<p>one</p>"), (6, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>one</p>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "kind") for r in rows], "page_id bigint, url string, html string, kind string")


def test_warc_round_trip(spark):
    got = {r["page_id"]: r for r in warc.page_records(pages(spark)).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [got[i]["refers_to"] for i in (0, 1, 2, 3, 5, None)] == [None, None, 1, 0, 0, 0]
    assert {i for i in got if got[i]["record_type"] == "revisit"} == {2, 3, 5, None}
    assert {r["page_id"] for r in warc.page_records(pages(spark), min_bytes=20).filter("record_type = 'revisit'").collect()} == set()
    assert warc.page_records(pages(spark, [])).count() == 0


def test_warc_of_repeated_and_odd_ids(spark):
    rows = [("a>b", "u", "one"), ("a>b", "u", "one"), ("new\r\nline", "u", "one"), ("é +%41", "u", "two"), ("", "u", "three"), (None, "u", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = sorted((r["page_id"] or "", r["payload_bytes"], r["record_type"], r["refers_to"] or "") for r in warc.page_records(df).collect())
    assert got == sorted([("a>b", 3, "response", ""), ("a>b", 3, "response", ""), ("new\r\nline", 3, "revisit", "a>b"), ("é +%41", 3, "response", ""), ("", 5, "response", ""), ("", 200_000, "response", "")])


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_follows_damage(spark, tmp_path, packed):
    whole = [warc.record(k, f"u{k}", (f"page {k} " * 50).encode()) for k in range(6)]
    parts = [warc.member(r) if packed else r for r in whole]
    damaged = bytearray(parts[1])
    damaged[len(damaged) // 2] ^= 0xFF
    data = b"noise" + parts[0] + bytes(damaged) + parts[2] + parts[3][:-9] + parts[4] + b"\x1f\x8b\x08 not a member" + parts[5] + b"WARC/"
    (tmp_path / "a.warc").write_bytes(data)
    table = spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "path string")
    found = warc.read_archives(table, with_payload=True).orderBy("start").collect()
    assert [r["record_id"] for r in found if r["kind"] == "response"] == [f"<urn:page:{k}>" for k in (0, 2, 4, 5)]
    assert [bytes(r["payload"]) for r in found if r["kind"] == "response"][1] == (b"page 2 " * 50)
    spans = [(r["start"], r["stop"]) for r in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(r["reason"] for r in found if r["kind"] == "gap") and sum(r["kind"] == "gap" for r in found) == 5


def test_salvage_inside_a_member():
    """A bad record of a member that holds several, and a member that breaks off."""
    records = [warc.record(k, f"u{k}", (f"page {k} " * 400).encode() + RNG.randbytes(300)) for k in range(5)]
    bad = bytearray(b"".join(records))
    bad[len(records[0]) + len(records[1]) - 40] ^= 1  # in the payload of record 1
    whole = warc.member(b"".join(records))
    data = warc.member(bytes(bad)) + whole[: len(whole) * 3 // 4] + warc.member(records[2])
    found = list(warc.Reader(io.BytesIO(data), len(data)).records())
    ids = [r.headers["warc-record-id"] for r in found if r.kind == "response"]
    broken_off = ids[4:-1]
    assert ids[:4] == [f"<urn:page:{k}>" for k in (0, 2, 3, 4)] and ids[-1] == "<urn:page:2>"
    assert broken_off == [f"<urn:page:{k}>" for k in range(len(broken_off))] and 1 <= len(broken_off) <= 3
    gaps = [r for r in found if r.kind == "gap"]
    assert len(gaps) == 2 and f"bytes {len(records[0])} to {len(records[0]) + len(records[1])} of the member" in gaps[0].reason
    assert gaps[1].stop == len(data) - len(warc.member(records[2])) and "member" in gaps[1].reason


# Mixing

def test_mixing(spark, docs):
    out = mixing.mix_sources(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    sizes = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        total = sizes.setdefault(r["source_size"], [0, r["target"], 0])
        total[0] += r["taken"]
        total[2] = max(total[2], r["size"])
    assert all(abs(taken - target) <= largest for taken, target, largest in sizes.values())
    assert sum(t for _, t, _ in sizes.values()) == pytest.approx(1.5 * sum(sizes))
    assert mixing.mixed_documents(docs).columns == [*docs.columns, "_copies"]


def test_a_source_of_repeated_rows_meets_its_target(spark):
    rows = [(1, "one two three four", "a")] * 200 + [(2, "a b c", "a")] * 50 + [(k, "w " * (k % 40), "b") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    by = {"weights": (1, 9), "share": 1.3}
    out = mixing.mix_sources(df, **by).collect()
    for size in {r["source_size"] for r in out}:
        assert sum(r["taken"] for r in out if r["source_size"] == size) == pytest.approx({r["target"] for r in out if r["source_size"] == size}.pop(), abs=20)
    assert {r["copies"] for r in out if r["doc_id"] == 1 and r["size"] == 4} == {0, 1}
    mixed = mixing.mixed_documents(df, **by).groupBy("source").agg(F.sum(F.col("copies") * mixing.n_words(F.col("text"))).alias("n")).collect()
    assert sorted(r["n"] for r in mixed) == sorted(sum(r["taken"] for r in out if r["source_size"] == size) for size in {r["source_size"] for r in out})


def test_documents_are_included_as_often_as_their_weights_ask_for(spark):
    rows = [(k, "w " * (1 + k % 30), "ab"[k % 2]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = [mixing.mix_sources(df, weights=(1, 3), share=0.6, seed=str(s)) for s in range(12)]
    copies = collections.Counter()
    for frame in out:
        for r in frame.collect():
            copies[r["doc_id"] % 2, r["size"]] += r["copies"]
    for source in (0, 1):
        sizes = [n for c, n in copies if c == source]
        got = np.array([copies[source, n] for n in sizes]) / 12 / 20
        weight = np.floor(16 * np.sqrt(sizes))
        target = {r["target"] for r in out[0].collect() if r["doc_id"] % 2 == source}.pop()
        level = target / (20 * (weight * sizes).sum())
        wanted = np.minimum(2, level * weight)
        if wanted.max() < 2:
            assert np.abs(got - wanted).max() < 0.25 and abs((got - wanted).mean()) < 0.03


def test_targets_stop_at_twice_a_source(spark, empty):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    # weights 3, 1, 2 and again 3: a and c stop at 20 and 0, None at 1000, and b has the rest
    assert got == {"a": 20.0, "b": pytest.approx(2265 - 20 - 1000), "c": 0.0, None: 1000.0}
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# Exact copies

def test_exact_groups(docs, texts, empty):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == docs.count()
    groups = {}
    for r in docs.collect():
        groups.setdefault(ascii_lower(r["text"] or ""), []).append(r["doc_id"])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in rows:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_slices_of_the_filter_change_nothing(docs, monkeypatch):
    wanted, left = sorted(map(str, exact_dedup.exact_groups(docs).collect())), sorted(map(str, exact_dedup.drop_exact_copies(docs).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_FLAGGED", 8)
    assert exact_dedup._groups(docs, "doc_id", "text").seen.n_slices > 1
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == wanted
    assert sorted(map(str, exact_dedup.drop_exact_copies(docs).collect())) == left


def test_the_filter_keeps_repeats_and_rules_out_most_others(spark):
    hashes = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") % 7)).alias("h"))
    seen = exact_dedup.repeat_filter(hashes)
    marked = [(r["h"], r["m"]) for rows, k in seen.split(hashes, "h") for r in seen.marked(rows, "h", k, "m").collect()]
    assert len(marked) == 20_000
    times = collections.Counter(h for h, _ in marked)
    assert all(m for h, m in marked if times[h] > 1) and sum(m for h, m in marked if times[h] == 1) < 0.1 * 19_000


CLASHES = ["keep_id", "win_sha", "win_id", "gone_id", "gone_hash", "own_hash", "hit_id", "hit_hash", "maybe", "h", "bloom_word", "row", "doc", "size", "u", "plan_source", "copies", "text_bytes", "key"]


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c", "s"), (2, "a b c", "s"), (None, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    item = spark.createDataFrame([(0, "x y")], "item_id bigint, text string")
    for kept, n in ((exact_dedup.drop_exact_copies(df), 2), (simhash.drop_near_copies(df), 2), (decontaminate.drop_contaminated(df, item), 2), (quality.keep_good(df, quality.train(df, spark.createDataFrame([], "doc_id bigint, quality int")), 0.0), 3)):
        assert kept.columns == df.columns and kept.count() == n
    assert mixing.mixed_documents(df).columns == [*df.columns, "_copies"]


# SimHash

def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text or "")) if x]
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowded", [20_000, 4])
def test_near_groups(docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", crowded)
    rows = docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    roots = brute_components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    out = simhash.near_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == sorted((str(i), f"{p:016x}", least.get(roots[p])) for i, p in prints)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is not null").select("doc_id").distinct().count() == len(set(least.values()))
    assert simhash.near_groups(empty).count() == 0


def test_near_copies_go_by_row(spark):
    a, b = "one two three four five six", "other words that are in no way like these"
    df = spark.createDataFrame([(1, a), (1, a), (5, b), (5, a), (None, b), (None, "and a third text of its own kind"), (7, None), (8, "")], "doc_id bigint, text string")
    assert sorted(map(str, simhash.drop_near_copies(df).collect())) == sorted(map(str, spark.createDataFrame([(1, a), (5, b), (None, "and a third text of its own kind"), (7, None)], df.schema).collect()))


@pytest.mark.parametrize("t", [0, 2, 4])
def test_all_pairs_within_the_distance_meet(t):
    rng = np.random.default_rng(t)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(a)):
        for bit in rng.choice(64, t, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    index, anchor = simhash.anchors(np.concatenate([a, b]), t)
    met = {}
    for i, x in zip(index.tolist(), anchor.tolist(), strict=True):
        met.setdefault(i, set()).add(x)
    assert all(met[k] & met[k + len(a)] for k in range(len(a)))


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {got[k] for k in range(301)} == {0} and {got[k] for k in range(1000, 1400)} == {1000} and 5000 not in got


# Repeated substrings

def brute_removed(rows, length=100):
    order = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for i, text in order:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                gone[s : s + length] = True
            seen.add(piece)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [1 << 16, 40])
def test_repeats(spark, empty, monkeypatch, bucket):
    """40: many buckets, with k-grams over their boundaries and leading bytes too frequent for one."""
    rng = random.Random(9)
    sentence = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    shared = [sentence(40) for _ in range(6)]
    texts = [None, "", "short", "ab" * 400, "x" * 350, "x" * 120, shared[0][:100], shared[0][:99]]
    for _ in range(80):
        texts.append(" ".join(rng.choice([sentence(rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 60) :]]) for _ in range(rng.randint(1, 6))))
    texts += [texts[9], texts[9] + "!", sentence(9000), shared[1] * 3]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, n_bytes int").repartition(6)
    wanted = brute_removed(rows)
    monkeypatch.setattr(substring_dedup, "PIECE", 3000)
    monkeypatch.setattr(substring_dedup, "BUCKET", bucket)
    monkeypatch.setattr(substring_dedup, "SORTED", bucket)
    out = substring_dedup.remove_repeats(df, digest=True).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out} == wanted
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_multikey_sort():
    rows = np.random.default_rng(0).integers(0, 3, (500, 21)).astype(np.uint8)
    assert [rows[k].tobytes() for k in substring_dedup.multikey_order(rows)] == sorted(r.tobytes() for r in rows)


# URLs

def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "Example.org", "/en/1"), ("block", "com", "/de/")]
    urls = {
        "http://example.org/es/x": ("example.org/es/", "block"), "https://a.EXAMPLE.org/en/12?q": ("example.org/en/1", "block"), "http://notexample.org/es/": ("org/", "allow"),
        "http://x.com/de/": ("com/de/", "block"), "http://x.com/de": (None, "allow"), "http://com/de/#/fr/": ("com/de/", "block"), "x.org/": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://org": (None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "p") for k, u in enumerate(urls)], "page_id bigint, url string, path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()}
    assert [got[k] for k in range(len(urls))] == list(urls.values())
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="path starts"):
        url_filter.filter_urls(df, [("allow", "a.b", "x")])


def test_digest_collisions_are_told_apart(spark, tmp_path):
    rules = [("block", f"h{k}.net", "/") for k in range(50)] + [("allow", "net", "/")]
    (tmp_path / "i").write_bytes(url_filter.index_bytes(rules, key=lambda r: len(r)))
    index = url_filter.DigestArray(f"file://{tmp_path}/i", key=lambda r: len(r))
    assert index.judge(["h7.net", "z7.net", "net", "h99.net"], ["/a", "/a", "/", "/"], "allow") == (["h7.net/", "net/", "net/", "net/"], ["block", "allow", "allow", "allow"])


# HTML

ARTICLE = "It was a bright, cold day in the north, and the clocks, all of them, were striking. " * 4


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (None, ""), ("", ""), ("<p>a &amp; b<br>c &#233;", "a & b c é"),
        (f"<html><head><title>T</title></head><body><nav><a href=1>Home</a></nav><article><h1>Head</h1><p>{ARTICLE}</p><p>Second, one.</p></article><footer>(c)</footer></body></html>", f"Head\n{ARTICLE.strip()}\nSecond, one."),
        (f"<div class=sidebar><p>{ARTICLE}</p></div><div id=x><p>{ARTICLE}<p>{ARTICLE}</div><div class='comments'><p>{ARTICLE}</p></div>", f"{ARTICLE.strip()}\n{ARTICLE.strip()}"),
        (f"<body><form action=x><input name=v><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><button>Go</button></form></body>", f"{ARTICLE.strip()}\n{ARTICLE.strip()}"),
        (f"<article><p>{ARTICLE}</p><p>So <math><mi>a</mi></math> is one.</p></article>", f"{ARTICLE.strip()}\nSo a is one."),
        (f"<article><p>{ARTICLE}</p><p class='notice-period'>Three months.</p><p class='notice'>Cookies!</p></article>", f"{ARTICLE.strip()}\nThree months."),
        (f"<body><div><p>{ARTICLE}</p></div>Loose text.<div><p>{ARTICLE}</p></div></body>", f"{ARTICLE.strip()}\nLoose text.\n{ARTICLE.strip()}"),
        (f"<body><div><p>{ARTICLE}</p></div><div><p>Short one.</p></div><div><a href=1>More</a> <a href=2>Links</a></div></body>", f"{ARTICLE.strip()}\nShort one."),
        (f"<main><article><p>{ARTICLE}</p></article><article><p>{ARTICLE}</p><article class=nested><p>{ARTICLE}</p></article>End.</article></main>", "\n".join([ARTICLE.strip()] * 3 + ["End."])),
        (f"<body><table><tr><td><p>{ARTICLE}</p></td></tr><tr><td>A cell.</td></tr></table><div class=x>Elsewhere</div></body>", f"{ARTICLE.strip()}\nA cell."),
        (f"<main><p>{ARTICLE}</p><script>var a = '<p>no</p>'</script><style>p {{}}</style><form><p>Mail, please, now</p></form></main>", ARTICLE.strip()),
    ],
)
def test_main_text(page, wanted):
    assert html_text.main_text(page) == wanted


def test_pages(spark):
    df = spark.createDataFrame([(0, "u", f"<article><p>{ARTICLE}</p></article>", "t"), (0, "u", None, "t"), (None, None, "<div>" * 3000 + "deep", None)], "page_id bigint, url string, html string, text string")
    out = html_text.extract(df).collect()
    assert len(out) == 3 and all(r["n_chars"] == len(r["text"]) for r in out) and html_text.extract(df.limit(0)).count() == 0


# Classifiers

@pytest.mark.parametrize(("module", "label", "threshold", "least"), [(quality, "quality", 0.3, 0.9), (toxicity, "toxic", 0.5, 0.9)])
def test_classifiers_on_held_out_labels(spark, module, label, threshold, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = module.score(docs, module.train(docs, labels), threshold).filter("held_out").join(labels, "doc_id")
    rows = scored.select("score", label).toPandas()
    rank = rows["score"].rank().to_numpy()
    y = rows[label].to_numpy() == 1
    area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > least


def test_grams_that_no_ordinary_document_has_are_significant():
    """In a sample of any size; and grams of a few copies or of either class alike are not."""
    for n in (400, 1700, 4000, 100_000):
        ordinary, toxic = np.array([0, 0, n // 50, n // 2, n // 3]), np.array([n // 3, n // 20, n // 40, n // 2, 0])
        assert toxicity.significant([ordinary, toxic], [n, n]).tolist() == [True, True, False, False, False]
    assert not toxicity.significant([np.zeros(3), np.zeros(3)], [0, 0]).any()


SYLLABLES = ["ba", "ke", "li", "mo", "nu", "ras", "tel", "vin", "dor", "sch"]


def test_the_toxic_dictionary_is_within_reach():
    """Its stretches are found behind an ordinary one of full size with the same syllables."""
    rng = np.random.default_rng(3)
    toxic, ordinary = (" ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n)).encode()[:n] for n in (toxicity.TOXIC, toxicity.ORDINARY))
    compress = toxicity.compressor(toxic + ordinary)
    assert max(len(compress(toxic[k : k + 48])) for k in range(0, len(toxic) - 48, 64)) < 25


def test_toxic_words_are_learned_from_a_large_sample(spark):
    """Half of 3400 documents hold one of four words three times, with other endings, that no other document has."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(SYLLABLES, rng.integers(1, 4)))
    rows = []
    for k in range(3400):
        words = [word() for _ in range(60)]
        for at in (10, 30, 50) if k % 2 else ():
            words[at] = ["zofquip", "wyxjaffe", "quophag", "xivjompt"][k // 2 % 4] + word()
        rows.append((k, " ".join(words), k % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    found = toxicity.score(docs.drop("toxic"), toxicity.train(docs, docs)).filter("held_out").collect()
    right = [r["predicted"] == r["doc_id"] % 2 for r in found]
    assert len(found) > 500 and np.mean(right) > 0.98


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_at_the_edges(spark, docs, empty, module, label):
    none = spark.createDataFrame([], f"doc_id bigint, {label} int")
    one = docs.select("doc_id").filter("doc_id < 30").withColumn(label, F.lit(1))
    for labels in (none, one, one.withColumn(label, (F.col("doc_id") % 2).cast("int")), one.withColumn(label, F.lit(None).cast("int"))):
        out = module.score(docs, module.train(docs, labels)).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert module.score(empty, module.train(docs, none)).count() == 0
    by_text = {}
    for r, t in zip(*[x.orderBy("doc_id").collect() for x in (module.score(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), module.train(docs, one)), docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))], strict=True):
        assert by_text.setdefault(t["text"] or "", r["score"]) == r["score"]
    kept = quality.keep_good(docs, quality.train(docs, none), 0.0) if module is quality else docs
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_the_shared_folder_is_that_of_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
