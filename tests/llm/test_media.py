"""Media columns against the metadata of whole payloads."""

import random
import struct

import zstandard
from glyphmill.llm import media


def page(words, head="", seed=1):
    rng = random.Random(seed)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(words))
    return f"<!DOCTYPE html><html><head>{head}<meta charset=\"ISO-8859-2\"><title>Page {words}</title></head><body><p>{text}</p></body></html>"


def jpeg(before):
    """A JPEG whose frame header stands behind segments of so many bytes."""
    segments = b"".join(b"\xff\xe2" + struct.pack(">H", n + 2) + bytes(n) for n in before)
    return b"\xff\xd8" + segments + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 480, 640, 3) + bytes(5000)


def wav(before):
    return b"RIFF" + bytes(4) + b"WAVE" + b"JUNK" + struct.pack("<I", before) + bytes(before) + b"fmt " + struct.pack("<IHHI", 16, 1, 2, 44100) + bytes(9000)


def payloads():
    style = "<style>" + " ".join(f".c{i}{{width:{i * 7919 % 997}px}}" for i in range(3000)) + "</style>"
    untitled = page(4000, seed=6).replace("<title>Page 4000</title>", "")
    text = [page(20), page(600), page(4000), page(40000), page(4000, style), page(4000, "<!--" + "x" * 1975), untitled]
    return [t.encode() for t in text] + [jpeg([100]), jpeg([3000]), jpeg([60000, 60000, 9000]), jpeg([]), wav(0), wav(7000), b"plain " * 20000, b"", b"\xff\xd8\xff\xe1"]


def test_metadata_of_whole_payloads(spark):
    given = payloads()
    assert len(given[2]) > 20_000
    rows = spark.createDataFrame(list(enumerate(given)), "id int, payload binary")
    for header_bytes in (media.HEADER_BYTES, 100):
        out, folder = media.store_media(rows, "payload", header_bytes=header_bytes)
        found = {r["id"]: r.asDict() for r in out.collect()}
        for i, payload in enumerate(given):
            assert {n: found[i][n] for n in media.META} == media.header_metadata(payload), i
            assert found[i]["size"] == len(payload)
        back = {r["id"]: bytes(r["payload"]) for r in media.read_payloads(out, folder).select("id", "payload").collect()}
        assert back == dict(enumerate(given))
    assert [found[i]["title"] for i in range(7)] == ["Page 20", "Page 600", "Page 4000", "Page 40000", "Page 4000", "Page 4000", None]
    assert all(found[i]["media_type"] == "text/html" and found[i]["charset"] == "iso-8859-2" for i in range(7))
    assert [found[i]["width"] for i in range(7, 11)] == [640] * 4 and [found[i]["sample_rate"] for i in (11, 12)] == [44100] * 2


class Ranges:
    """A file that counts the bytes read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += len(part := self.data[at : at + n])
        return part


def test_a_large_page_is_not_read_whole():
    encoding, stored = media._store(page(40000).encode())
    assert zstandard.ZstdDecompressor().decompress(stored) == page(40000).encode()
    file = Ranges(stored)
    media._read_start(file, 0, len(stored), encoding, media.HEADER_BYTES)
    assert file.read == media.HEADER_BYTES < len(stored) / 20


def test_repeats_nulls_and_clashing_names(spark):
    rng = random.Random(2)
    once = [page(50, seed=i).encode() for i in range(40)]
    rows = [(i, once[i]) for i in range(40)] + [(100 + i, once[0]) for i in range(30)] + [(200 + i, b"") for i in range(5)] + [(300, None), (301, None), (None, once[1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, a, a, a) for a, b in rows], "id int, html binary, gm_stored int, title int, gm_payload int").repartition(5)
    out, folder = media.store_media(df, "html", shard_bytes=3000)
    assert out.columns == ["id", "gm_stored", "gm_payload", *media.PLACE, *media.META]
    got = out.collect()
    assert len(got) == len(rows) and all(r["id"] == r["gm_stored"] == r["gm_payload"] for r in got)
    members = {}
    for r in got:
        if r["digest"] is not None:
            members.setdefault(bytes(r["digest"]), set()).add((r["shard"], r["offset"], r["length"]))
    assert len(members) == 41 and all(len(m) == 1 for m in members.values())
    assert [r["media_type"] for r in got if r["id"] is not None and 200 <= r["id"] < 300] == ["application/x-empty"] * 5
    assert all(r[c] is None for r in got if r["id"] in (300, 301) for c in media.PLACE + media.META)
    back = {(r["id"], None if r["payload"] is None else bytes(r["payload"])) for r in media.read_payloads(out, folder).select("id", "payload").collect()}
    assert back == set(rows)
    assert media.remove_unnamed(out, folder) == 0


def test_shards_are_tar_files_with_each_payload_once(spark):
    import glob
    import hashlib
    import tarfile

    given = [page(30, seed=i % 7).encode() for i in range(20)]
    out, folder = media.store_media(spark.createDataFrame([(p,) for p in given], "p binary").repartition(3), "p")
    out.collect()
    found = {}
    for name in glob.glob(folder.removeprefix("file://") + "/*.tar"):
        with tarfile.open(name) as tar:
            for m in tar:
                data = zstandard.ZstdDecompressor().decompressobj().decompress(tar.extractfile(m).read())
                assert m.name.removesuffix(".zst") == hashlib.sha256(data).hexdigest() and m.name not in found
                found[m.name] = data
    assert sorted(found.values()) == sorted(set(given))


def test_empty_table(spark):
    out, folder = media.store_media(spark.createDataFrame([], "id int, p binary"), "p")
    assert out.count() == 0 and out.columns == ["id", *media.PLACE, *media.META]
