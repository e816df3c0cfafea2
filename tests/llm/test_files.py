import base64
import collections
import gzip
import hashlib
import json
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import merkle, sharding, warc


def test_merkle_neighbours(plain, odd, none, odd_rows):
    rows, df = plain
    rows = sorted(rows, key=lambda r: r[0])
    texts = [r[1] or "" for r in rows]
    got = {r.doc_id: r for r in merkle.compare_neighbours(df).collect()}
    for k, (doc, *_) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == merkle.fingerprints([text])[0] and r.edited_fingerprint == merkle.fingerprints([edited])[0]
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (text == edited)
    assert merkle.compare_neighbours(odd).count() == len(odd_rows)
    assert merkle.compare_neighbours(none).count() == 0
    one = df.where("doc_id = 5")
    assert merkle.compare_neighbours(one).first().near_next == 1.0


def windows_of(text):
    """Distinct runs of up to eight bytes that end at each byte and stay in its line."""
    out = set()
    for line in text.encode().splitlines(keepends=True) if "\r" not in text else []:
        out |= {line[max(0, i - 7) : i + 1] for i in range(len(line))}
    return out


def test_likeness_is_the_share_of_leaves():
    """Against sets of windows in plain Python: equal where no leaf is left out, near beyond; alike at every length."""
    word = lambda k: "abcdefghij"[k % 10] * (1 + k % 3) + str(k)
    for n in (0, 1, 2, 5, 12, 20, 64, 65, 300, 4000):
        a = " ".join(word(7 * i) for i in range(n))
        b = merkle.edit(a, "\n".join(word(5 * i + 3) for i in range(n)))
        x, y = windows_of(a), windows_of(b)
        exact = 2 * len(x & y) / max(1, len(x) + len(y)) if a != b else 1.0
        got = merkle.likeness(*merkle.fingerprints([a, b]))
        if max(len(x), len(y)) <= merkle.LEAVES:
            assert abs(got - min(exact, 1)) < 1e-5, n
        assert abs(got - exact) < 0.15, n
        assert n < 2 or 0.3 < got < 0.8, n
    assert merkle.likeness(*merkle.fingerprints(["ab", "aX"])) == 0.5


def test_merkle_locates_edits():
    lines = [f"line {k} " + " ".join(f"w{k * 31 + i}" for i in range(30)) for k in range(40)]
    before = "\n".join(lines)
    lines[17] = "something else altogether"
    a, b = merkle.fingerprints([before, "\n".join(lines)])
    assert merkle.locate(a, b) == [(17, 18)] and merkle.locate(a, a) == []
    assert 0.9 < merkle.likeness(a, b) < 1
    same, spaced = merkle.fingerprints(["a  b c", "a b c"])
    assert same.split("|")[0] != spaced.split("|")[0] and merkle.likeness(same, spaced) < 1


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>y</p>"), (3, "http://a/\n3", "<p>x</p>"), (4, None, None), (5, "http://a/5", ""), (6, "u", "é🙂" * 9000), (None, "http://n", "<p>x</p>"), (-7, "u", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        kept = first.setdefault(body, page)
        r = got[page]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if kept == page else ("revisit", kept))
    assert warc.round_trip(pages.limit(0)).count() == 0
    longer = warc.round_trip(pages, least_bytes=100)
    assert longer.where("record_type = 'revisit'").count() == 0


def test_package_contents(tmp_path):
    """A warcinfo record first, an index sorted by URL, digests of the members, and records by URL."""
    uri = f"file://{tmp_path}/p.zip"
    out = warc.PackageWriter(uri)
    urls = ["https://www.example.org/b?q=1", "http://example.com:8080/", "http://a.example.org/x y", "not a url", "", "https://www.example.org/b?q=1", "http://[bad"]
    for k, url in enumerate(urls):
        out.add(k, url, f"body {k}".encode(), 0 if k == 5 else None)
    assert out.close() == len(urls)
    package = warc.Package(uri)
    lines = package.read(warc.INDEX).decode().splitlines()
    assert lines == sorted(lines) and len(lines) == len(urls) and any(x.startswith("org,example,www)/b?q=1 20260101000000 {") for x in lines)
    assert [r.headers["warc-type"] for r in package.find("https://WWW.example.org/b?q=1")] == ["response", "revisit"]
    assert package.find("http://example.com:8080/")[0].payload == b"body 1" and package.find("http://nowhere/") == []
    about = json.loads(package.read(warc.ABOUT))
    for part in about["resources"]:
        raw = package.read(part["path"])
        assert part["bytes"] == len(raw) and part["hash"] == "sha256:" + hashlib.sha256(raw).hexdigest()
    assert gzip.decompress(package.read(warc.DATA)).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert [r.http["content-length"] for r in package.records()] == ["6"] * len(urls)


def test_warc_zip64(tmp_path, monkeypatch):
    """With the limits lowered, sizes and offsets move into the ZIP64 fields."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    uri = f"file://{tmp_path}/a.zip"
    out = warc.PackageWriter(uri)
    for k in range(30):
        out.add(k, f"http://h/{k}", f"body {k}".encode() * k, None)
    assert out.close() == 30
    raw = (tmp_path / "a.zip").read_bytes()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    package = warc.Package(uri)
    assert [r.payload for r in package.records()] == [f"body {k}".encode() * k for k in range(30)]
    with zipfile.ZipFile(tmp_path / "a.zip") as z:  # the standard library reads it too
        assert z.read(warc.DATA) == package.read(warc.DATA)


def test_sharding(odd, odd_rows, none):
    got = sharding.shard_rows(odd, 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(odd_rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    want = collections.Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in odd_rows)
    assert collections.Counter(zip(got["size"], got.text_crc32)) == want
    assert sharding.shard_rows(none).count() == 0


def test_communication_matrix():
    """Sums are exact and cells have the mean and spread of a uniform shuffle."""
    counts = [40, 0, 100, 60]
    draws = np.array([sharding.communication_matrix(counts, 5, s) for s in range(600)])
    assert (draws.sum(2) == counts).all() and (draws.sum(1) == 40).all()
    assert np.allclose(draws.mean(0)[2], 20, atol=0.6)
    assert abs(draws[:, 2, 0].var() - 40 * 0.5 * 0.5 * 160 / 199) < 1.5  # hypergeometric


def test_large_hypergeometric():
    rng = np.random.default_rng(1)
    got = [sharding._hypergeometric(rng, 10**9, 3 * 10**9, 1000) for _ in range(3000)]
    assert abs(np.mean(got) - 250) < 1.5 and abs(np.var(got) - 187.5) < 20
