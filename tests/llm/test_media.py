"""Matroska files, ZIP packages, URL verdicts and near-duplicates on small tables, against plain Python."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import struct
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimweave.llm import components, matroska, minmax_dedup, url_filter, zip_warc


def test_laces_of_all_kinds_come_back():
    r = random.Random(1)
    for kind in (0, 1, 2, 3):
        for _ in range(100):
            n, same = 1 if kind == 0 else r.randint(2, 8), r.randint(1, 900)
            frames = [r.randbytes(same if kind == 2 else r.choice([0, 1, 254, 255, 256, r.randint(0, 20_000)])) for _ in range(n)]
            block = matroska.lace_block(1, 5, frames, kind)
            assert [block[at : at + size] for at, size in matroska.laces(block, 4, len(block), kind)] == frames


def test_packets_lie_where_the_table_says():
    samples = random.Random(2).randbytes(64 * 12_000)
    media = matroska.write_sound(samples)
    found = matroska.parse(media)
    assert found.error is None and b"".join(media[at : at + size] for _, _, at, size, _, _ in found.packets) == samples
    assert [p[1] for p in found.packets] == [k * 512_000_000 for k in range(len(found.packets))]
    assert len(found.cues) == found.packets[-1][4] + 1 > 1 and all(media[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in found.cues)
    for end in range(0, 400, 7):
        assert len(matroska.parse(media[:end]).packets) == 0


def test_unknown_sizes_groups_and_other_tracks():
    e, m = matroska.element, matroska
    cluster = lambda time, body: m._id(m.CLUSTER) + b"\xff" + e(m.CLUSTER_TIMESTAMP, time) + body
    body = e(m.INFO, e(m.TIMESTAMP_SCALE, 500_000)) + cluster(10, e(m.SIMPLE_BLOCK, m.lace_block(1, 2, [b"abc"]))) + cluster(20, e(0xEC, b"void") + e(m.BLOCK_GROUP, e(m.BLOCK, m.lace_block(300, -3, [b"de", b"fgh"]))))
    media = e(m.EBML, e(m.DOC_TYPE, "matroska")) + m._id(m.SEGMENT) + bytes.fromhex("01ffffffffffffff") + body
    found = m.parse(media)
    assert found.error is None and [(t, ns, media[a : a + n], c) for t, ns, a, n, c, _ in found.packets] == [(1, 6_000_000, b"abc", 0), (300, 8_500_000, b"de", 1), (300, 8_500_000, b"fgh", 1)]


def test_damaged_laces_and_frames_that_refer_to_others():
    e, m = matroska.element, matroska
    for kind in (1, 2, 3):
        cut_off = e(m.SIMPLE_BLOCK, m.vint(1) + struct.pack(">hB", 0, kind << 1))
        good = e(m.SIMPLE_BLOCK, m.lace_block(1, 2, [b"abc"]))
        found = m.parse(e(m.EBML, b"") + e(m.SEGMENT, e(m.CLUSTER, e(m.CLUSTER_TIMESTAMP, 1) + good + cut_off)))
        assert len(found.packets) == 1 and "lace" in found.error
    groups = [e(m.BLOCK_GROUP, e(m.BLOCK, m.lace_block(1, 0, [b"k"]))), e(m.BLOCK_GROUP, e(m.BLOCK, m.lace_block(1, 1, [b"p"])) + e(m.REFERENCE_BLOCK, b"\xff"))]
    assert [p[-1] for p in m.parse(e(m.SEGMENT, e(m.CLUSTER, b"".join(groups)))).packets] == [True, False]


def test_texts_as_sound(spark):
    texts = ["", None, "x" * 63, "x" * 64, "x" * 65, "é" * 20_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    keys = ["doc_id", "n_bytes"]
    parsed = matroska.packets(matroska.sound_column(docs, ["doc_id"]), keys)
    got = {r.doc_id: r for r in matroska.payload_digests(parsed, keys).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[6][1:] == got[7][1:]
    odd = matroska.packets(spark.createDataFrame([(1, None), (2, b"\x00junk"), (3, matroska.write_sound(b"x" * 64)[:90])], "doc_id long, media binary"), ["doc_id"])
    assert [tuple(r)[0] for r in odd.select(F.size("packets")).collect()] == [0, 0, 0] and odd.where("doc_id = 1").first().error is None and odd.where("error is not null").count() == 2
    empty = {r.doc_id: (r.payload_bytes, r.feature) for r in matroska.payload_digests(odd, ["doc_id"]).collect()}
    assert empty == {1: (None, None), 2: (0, "packets=0;ms=0;peak=0;energy=0;crossings=0"), 3: (0, "packets=0;ms=0;peak=0;energy=0;crossings=0")}
    assert matroska.payload_digests(matroska.packets(matroska.sound_column(docs.limit(0), ["doc_id"]), keys), keys).isEmpty()


def test_zip64_directories_and_stored_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(f"m{i}", str(i))
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"big one")
        z.writestr("packed", b"x" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"PK a comment"
    raw = out.getvalue()
    fetch = lambda at, n: raw[at : at + n]
    members = zip_warc.directory(fetch, len(raw))
    assert len(members) == 66_002
    for name, want in (("m65999", b"65999"), ("big", b"big one")):
        at = zip_warc.stored_at(fetch, members[name])
        assert raw[at : at + members[name].size] == want
    with pytest.raises(zip_warc.BadArchive):
        zip_warc.stored_at(fetch, members["packed"])
    for bad in (b"", b"PK", raw[:5000]):
        with pytest.raises(zip_warc.BadArchive):
            zip_warc.directory(lambda at, n, bad=bad: bad[at : at + n], len(bad))


def a_record(i, kind="response", body=None):
    body = b"p" * i if body is None else body
    return zip_warc.record(kind, f"urn:page:{i}", f"http://www.x.org/{i}", hashlib.sha1(body).hexdigest(), len(body), body, None)


@pytest.mark.parametrize("zip64", [False, True])
def test_records_are_read_by_ranges(zip64):
    held = [(f"http://www.x.org/{i}", a_record(i)) for i in range(200)]
    raw, asked = zip_warc.package(held, zip64), []
    found = list(zip_warc.records(lambda at, n: asked.append(n) or raw[at : at + n], len(raw)))
    assert [r for *_, r in found] == [r for _, r in held] and zip_warc.package(held, zip64) == raw
    warc = zip_warc.directory(lambda at, n: raw[at : at + n], len(raw))["archive/data.warc.gz"]
    assert sum(n < warc.size // 10 for n in asked) >= 200  # no member is read whole but the index
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == ["archive/data.warc.gz", "indexes/index.cdxj"]
        lines = z.read("indexes/index.cdxj").decode().splitlines()
        assert lines == sorted(lines) and all(x.startswith("org,x,www)/") and int(json.loads(x.split(" ", 2)[2])["offset"]) >= 0 for x in lines)
    if zip64:
        assert raw[-22:][:4] == b"PK\x05\x06" and raw[-42:][:4] == b"PK\x06\x07" and raw.count(b"PK\x06\x06") == 1


def test_other_peoples_packages(spark, tmp_path):
    records = [a_record(i) for i in (0, 3, 70_000)]
    packed = [gzip.compress(r) for r in records]
    foreign = f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: text/plain\r\nWARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(b'hi').digest()).decode()}\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n".encode()
    at, lines = 0, []
    for k, p in enumerate(packed):
        lines.append(f"org,x)/{k} 2024 {json.dumps({'offset': at, 'length': len(p), 'filename': 'one.warc.gz'})}\n")
        at += len(p)
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(packed))
        z.writestr("archive/two.warc.gz", b"".join(map(gzip.compress, [records[1], foreign])))
        z.writestr("archive/three.warc", foreign + records[2] + records[0])
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.cdx.gz", gzip.compress("".join(lines).encode()))
        z.writestr("indexes/again.cdxj", "!meta\n" + lines[0], zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(tmp_path / "empty.wacz", "w") as z:
        z.writestr("archive/none.warc.gz", b"")
    paths = [(f"file://{tmp_path}/a.wacz", 1), (f"file://{tmp_path}/empty.wacz", 2), (None, 3)]
    got = zip_warc.read_packages(spark.createDataFrame(paths, "path string, member int")).collect()
    assert sorted((r.member, r.record_type, r.payload_bytes) for r in got) == [("one.warc.gz", "response", 0), ("one.warc.gz", "response", 3), ("one.warc.gz", "response", 70_000), ("three.warc", "resource", 2), ("three.warc", "response", 0), ("three.warc", "response", 70_000), ("two.warc.gz", "resource", 2), ("two.warc.gz", "response", 3)]
    whole = (tmp_path / "a.wacz").read_bytes()
    stored = {m: zip_warc.stored_at(lambda at, n: whole[at : at + n], x) for m, x in zip_warc.directory(lambda at, n: whole[at : at + n], len(whole)).items() if m.startswith("archive/")}
    for r in got:
        begin = stored[f"archive/{r.member}"] + r.offset
        raw = whole[begin : begin + r.length]
        assert zip_warc.parse_record(gzip.decompress(raw) if r.member.endswith(".gz") else raw)[0]["warc-record-id"].strip("<>") == r.record_id
        assert r.payload_digest == (hashlib.sha1(b"hi").hexdigest() if r.record_type == "resource" else hashlib.sha1(b"p" * r.payload_bytes).hexdigest())
    (tmp_path / "bad.wacz").write_bytes(whole[:-300])
    with pytest.raises(Exception, match="BadArchive"):
        zip_warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/bad.wacz",)], "path string")).collect()


def test_equal_payloads_are_stored_once(spark, tmp_path):
    rows = [(1, "u", "x" * 2000), (None, "u\r\nü", "x" * 2000), (2, None, "x" * 2000), (2, None, "x" * 2000), (3, "a", None), (4, "a", "é" * 600), (None, "b", "z" * 3000), (None, "b", "z" * 3000), (5, "c", "s" * 999), (6, "c", "s" * 999)]
    pages = spark.createDataFrame([(*r, "clash", "path") for r in rows], "page_id long, url string, html string, digest string, path string")
    read = lambda df, name: zip_warc.read_packages(zip_warc.write_packages(df, f"file://{tmp_path}/{name}"))
    number = lambda urn: int((urn or "urn:page:").removeprefix("urn:page:") or 0)
    got = sorted(((number(r.record_id), r.payload_bytes, r.record_type, number(r.refers_to), r.payload_digest) for r in read(pages, "all").collect()))
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == "x" * 2000 and i != 2
        want.append((i or 0, len(body), "revisit" if revisit else "response", 2 if revisit else 0, hashlib.sha1(body).hexdigest()))
    assert got == sorted(want)
    assert read(pages.limit(0), "none").isEmpty()


URLS = [f"https://{h}/{p}" for h in ("a.net", "b.example.net", "c.org", "d.example.com", "spam.example.com", "e.org") for p in ("en/1", "fr/2", "de/3?q=1", "en/44#t", "fr/news/5")]
ODD = [None, "", "no scheme", "HTTP://UP.Example.NET", "http://É.net/é", "https://x.net?y/z", "ftp://org/fr/", "http://notnet/fr/", "://net/", "a://b://net/"]


def by_hand(urls):
    """The models and the threshold by counting in dictionaries."""
    order, rules = url_filter.ORDER, sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def split(url):
        if "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        return host.translate(low), rest[len(host) :].split("?")[0].split("#")[0]

    def ruled(url):
        host, path = split(url)
        return next(((h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))

    held = {u for u in urls if ((xxhash.xxh64_intdigest(u.encode(), seed=42) + 2**63) % 2**64 - 2**63) % 5 == 0}
    counts = {v: defaultdict(lambda: defaultdict(int)) for v in ("allow", "block")}
    grams = lambda u: [(url_filter.START * (order - 1) + u + url_filter.END)[i : i + order] for i in range(len(u) + 1)]
    for u in urls:
        v = ruled(u)[1]
        if v and u not in held:
            for g in grams(u):
                for k in range(order):
                    counts[v][g[order - 1 - k : -1]][g[-1]] += 1

    def p(v, g):
        q = 1 / url_filter.SYMBOLS
        for k in range(order):
            seen = counts[v].get(g[order - 1 - k : -1])
            if seen:
                q = (seen.get(g[-1], 0) + len(seen) * q) / (sum(seen.values()) + len(seen))
        return q

    score = {u: sum(math.log(p("allow", g) / p("block", g)) for g in grams(u)) / len(grams(u)) for u in set(urls)}
    labelled = [(math.floor(score[u] * 100), ruled(u)[1] == "allow") for u in set(urls) if u in held and ruled(u)[1]]
    good, bad = sum(g for _, g in labelled), sum(not g for _, g in labelled)
    t = min(((-(sum(b < c for b, g in labelled if not g) * good - sum(b < c for b, g in labelled if g) * bad), c) for c, _ in labelled), default=(0, 0))[1] / 100 if good and bad else 0.0
    return {u: (*split(u), *ruled(u), score[u]) for u in urls}, t


def test_urls_are_judged_as_by_hand(spark):
    urls = URLS + [u for u in ODD if u] + URLS[:3]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, None, ""])], "page_id long, url string, host string")
    want, t = by_hand([*urls, "", ""])
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, rule, verdict, score = want[([*urls, "", ""])[r.page_id]]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.score == pytest.approx(score, abs=2e-6)
        assert r.verdict == (verdict or ("allow" if score >= t else "block"))
    unruled = url_filter.judge(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")).first()
    assert (unruled.score, unruled.verdict) == (0.0, "allow")
    assert url_filter.judge(pages.limit(0)).isEmpty()


def classes_by_hand(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:j] + ["new"] * (i % 4) + base[j:])) for i in range(40) for j in [r.randint(0, 59)]]
    for i in range(40, 100):  # a group in which most are near some others and few near all
        words = list(base)
        for _ in range(r.randint(1, 9)):
            words[r.randint(0, 59)] = f"x{r.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(r.choices(base, k=40))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "ONE two"), (205, "two one"), (206, "É é"), (207, "é é"), (208, "a b c d"), (209, "a b c d e"), (210, "a\xa0b c d")]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, bands string, n long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_duplicates(docs, shingle=k).collect()}
    want = classes_by_hand(rows, k, 80)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_null_and_repeated_ids(spark):
    text, near = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(31))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, None), (9, "else where"), (9, near), (11, "else where"), (None, "far off"), (None, "far off"), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in minmax_dedup.near_duplicates(docs).collect()))
    assert got == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 5, False), (3, 3, True), (3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 9, True), (11, 9, False)]
    # Rows are judged by their texts: one row of each group stays, the unlike texts of one id are apart, empty ones all stay.
    clash = docs.withColumns({"row": F.lit(1), "component": F.lit(2), "kept": F.lit(3), "mark": F.lit(4), "node": F.lit(5)})
    kept = minmax_dedup.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "far off"), (3, ""), (3, ""), (5, text), (9, "else where")]
    assert minmax_dedup.near_duplicates(docs.limit(0)).isEmpty() and minmax_dedup.keep_one(docs.limit(0)).isEmpty()


def test_signatures_estimate_without_bias():
    own, draw = minmax_dedup.Shingler(1), minmax_dedup._permutations(4096)
    a, b = " ".join(f"w{i}" for i in range(90)), " ".join(f"w{i}" for i in range(10, 100))
    one, two = (minmax_dedup._bands(own.shingles(t), *draw, 1) for t in (a, b))
    assert len(one) == 2 * 4096 and abs(float(np.mean(one == two)) - 0.8) < 0.02


def test_bitmaps_never_rule_out_a_link():
    r, own, ruled_out = random.Random(9), minmax_dedup.Shingler(2), 0
    for _ in range(400):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 3, 40, 300, 2000]))]
        near = [w if r.random() > r.choice([0, 0.05, 0.3]) else "x" for w in words][: r.randint(1, 2000)]
        a, b = own.shingles(" ".join(words)), own.shingles(" ".join(near))
        both = len(np.intersect1d(a, b))
        if not minmax_dedup._may_link(minmax_dedup._bitmap(a), minmax_dedup._bitmap(b), len(a), len(b), 80):
            ruled_out += 1
            assert 100 * both < 80 * (len(a) + len(b) - both)
    assert ruled_out > 100


@pytest.mark.parametrize("cell", [500, 3])
def test_rare_shingles_lose_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(minmax_dedup, "CELL", cell)
    r, sets = random.Random(7), []
    for i in range(150):
        base = sets[r.randrange(len(sets))] if sets and r.random() < 0.7 else set(range(1000, 1040)) | {r.randrange(2**62) for _ in range(r.randint(1, 30))}
        sets.append({h if r.random() > 0.06 else r.randrange(2**62) for h in base})
    words = ", ".join(f"s{k} long" for k in range(minmax_dedup.SKETCH))
    rows = spark.createDataFrame([(i, sorted(s), *minmax_dedup.sketch(np.array(sorted(s), np.uint64)).tolist()) for i, s in enumerate(sets)], f"node long, hashes array<long>, {words}")
    sizes = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node long, n long, component long")
    got = {(x.a, x.b) for x in minmax_dedup.rare_pairs(rows, sizes, 80).collect()}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want <= got and len(got) < 150 * 149 // 4 and len(want) > 20


def test_components_of_chains_and_stars(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 40)] + [(1, 1), (None, 3), (200, 201), (201, 200)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 40)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def damaged(r, whole):
    """Copies of whole with bytes changed, cut out or put in, or the end cut off."""
    for _ in range(300):
        raw = bytearray(whole)
        for _ in range(r.choice([1, 1, 2, 8])):
            at = r.randrange(len(raw))
            kind = r.random()
            if kind < 0.5:
                raw[at] = r.choice([0, 1, 0x7F, 0x80, 0xFF, r.randrange(256)])
            elif kind < 0.7:
                del raw[at : at + r.randint(1, 40)]
            elif kind < 0.9:
                raw[at:at] = r.choice([b"\xff" * r.randint(1, 12), r.randbytes(r.randint(1, 12)), b"-500"])
            elif at:
                del raw[at:]
        yield bytes(raw)


def test_damaged_media_never_stop_a_job(spark):
    e, m, r = matroska.element, matroska, random.Random(20)
    cluster = lambda time: e(m.CLUSTER, e(m.CLUSTER_TIMESTAMP, time) + e(m.SIMPLE_BLOCK, m.lace_block(1, 2, [b"abc"])))
    head = e(m.EBML, b"")
    beyond = [e(m.SEGMENT, cluster(1) + cluster(b"\xff" * 12)), e(m.SEGMENT, e(m.INFO, e(m.TIMESTAMP_SCALE, 1 << 63)) + cluster(1)), e(m.SEGMENT, cluster(1) + e(m.CUES, e(m.CUE_POINT, e(m.CUE_TIME, b"\x01" + bytes(8)) + e(m.CUE_TRACK_POSITIONS, e(m.CUE_TRACK, 1))))), e(m.SEGMENT, cluster(1) + e(m.CUES, e(m.CUE_POINT, e(m.CUE_TIME, 1) + e(m.CUE_TRACK_POSITIONS, e(m.CUE_TRACK, (1 << 64) - 1)))))]
    kept = [len(m.parse(head + x).packets) for x in beyond]
    assert kept == [1, 0, 1, 1] and all(m.parse(head + x).error for x in beyond)
    limit = m.parse(head + e(m.SEGMENT, e(m.INFO, e(m.TIMESTAMP_SCALE, 1)) + cluster((1 << 63) - 3)))
    assert limit.error is None and limit.packets[0][1] == (1 << 63) - 1
    files = [head + x for x in beyond] + list(damaged(r, m.write_sound(r.randbytes(9000)))) + [b"", b"\x1a", r.randbytes(500)]
    media = spark.createDataFrame([(i, f) for i, f in enumerate(files)] + [(None, None)], "i long, media binary")
    found = m.packets(media, ["i"]).select("i", "error", F.size("packets").alias("n")).collect()
    assert len(found) == len(files) + 1 and sum(x.error is not None for x in found) > 50 and any(x.error and x.n for x in found)


def test_damaged_packages_end_in_one_kind_of_error():
    r = random.Random(21)
    body = b"".join(a_record(i) for i in range(3))
    whole = [zip_warc.package([("http://a.b/c", a_record(i)) for i in range(4)], zip64=True), zip_warc.stored_zip([("archive/plain.warc", body)], False), zip_warc.stored_zip([("archive/x.warc.gz", b"".join(gzip.compress(a_record(i)) for i in range(3)))], False)]
    shrunk = body.replace(b"Content-Length: ", b"Content-Length: -", 1)
    fine = bad = 0
    for raw in [zip_warc.stored_zip([("archive/plain.warc", shrunk)], False), *(d for w in whole for d in damaged(r, w))]:
        steps = 0

        def fetch(at, n, raw=raw):
            nonlocal steps
            steps += 1
            assert steps < 5000, "reading doesn't end"
            return raw[at : at + n]

        try:
            for _, _, _, found in zip_warc.records(fetch, len(raw)):
                zip_warc.parse_record(found)
            fine += 1
        except (zip_warc.BadArchive, ValueError):
            bad += 1
    assert fine > 50 and bad > 200


def test_records_of_a_large_package_are_dealt_out(spark, tmp_path, monkeypatch):
    """Windows of a package go to several tasks, and rows are those of the whole."""
    monkeypatch.setattr(zip_warc, "WINDOW", 2000)
    many = [(f"http://a.b/{i}", a_record(i)) for i in range(60)]
    (tmp_path / "one.wacz").write_bytes(zip_warc.package(many))
    files = spark.createDataFrame([(f"file://{tmp_path}/one.wacz",), (None,)], "path string")
    found = zip_warc.read_packages(files)
    assert found.count() == 60 and found.select(F.spark_partition_id()).distinct().count() > 1
    assert found.select("offset").distinct().count() == 60
    long = "<p>" + "long words " * 400_000
    pages = spark.createDataFrame([(1, "http://a.b/", long), (2, None, long), (3, "http://a.b/", None)], "page_id long, url string, html string")
    (tmp_path / "long").mkdir()
    back = {x.record_id: (x.payload_bytes, x.record_type) for x in zip_warc.read_packages(zip_warc.write_packages(pages, f"file://{tmp_path}/long")).collect()}
    assert back == {"urn:page:1": (len(long), "revisit"), "urn:page:2": (len(long), "response"), "urn:page:3": (0, "response")}
