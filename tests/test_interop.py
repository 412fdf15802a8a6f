import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointlake.operators import changes as C
from pointlake.sources import interop as I
from pointlake.types import Corrupted, InvalidPointId, payload_row
from pyspark.sql import functions as F

PAYLOAD = payload_row({"n": 1, "d": 2.0, "s": "ü", "t": ["a"], "b": True, "z": None})
IDS = ["a", "réponse", "🧭", "x" * 512]


def test_round_trips():
    m = np.random.default_rng(1).normal(size=(25, 8)).astype(np.float32)
    m[0, 0], m[1, 1] = np.nan, -0.0
    assert I.decode_vectors(I.encode_vectors(m)).tobytes() == m.tobytes()
    assert I.decode_vectors(I.encode_vectors(m[:0])).shape == (0, 8)
    assert I.decode_ids(I.encode_ids(IDS)) == IDS and I.decode_ids(I.encode_ids([])) == []
    assert I.decode_payloads(I.encode_payloads([PAYLOAD, {}])) == [PAYLOAD, {}]
    assert I.encode_vectors(m)[:4] == b"VVEC" and len(I.encode_vectors(m)) == 28 + 25 * 8 * 4 + 4
    assert json.loads(I.payload_json(PAYLOAD)) == {"n": {"int": {"_0": 1}}, "d": {"double": {"_0": 2.0}}, "s": {"string": {"_0": "ü"}}, "t": {"strings": {"_0": ["a"]}}, "b": {"bool": {"_0": True}}, "z": {"null": {}}}
    with pytest.raises(ValueError):
        I.payload_json(payload_row({"d": float("nan")}))


@pytest.mark.parametrize("data, decode, header", [(I.encode_vectors(np.ones((3, 2), np.float32)), I.decode_vectors, 28), (I.encode_ids(IDS), I.decode_ids, 16), (I.encode_payloads([PAYLOAD]), I.decode_payloads, 16)])
def test_every_flipped_byte_is_found(data, decode, header):
    for i in [*range(0, 20), *range(header, len(data), 7), len(data) - 1]:
        bad = bytearray(data)
        bad[i] ^= 0x41
        if header == 28 and 20 <= i < 28:
            continue  # flags and the reserved field aren't covered
        with pytest.raises(Corrupted):
            decode(bytes(bad))
    for cut in (0, 10, header, len(data) - 1):
        with pytest.raises(Corrupted):
            decode(data[:cut])
    with pytest.raises(Corrupted):
        decode(data + b"\0")


def test_checks_beyond_checksums():
    def sealed(body, n=1, magic=b"VIDS"):
        return magic + struct.pack("<IQ", 1, n) + body + struct.pack("<I", zlib.crc32(body))

    for body in (b"\1\0\xff", b"\0\0", b"\5\0ab", b"\1\0aX"):
        with pytest.raises(Corrupted):
            I.decode_ids(sealed(body))
    for raw in (b"{", b'{"a":1}', b'{"a":{"int":{"_0":"x"}}}', b'{"a":{"int":{"_0":true}}}', b'{"a":{"map":{"_0":1}}}', b"[]"):
        with pytest.raises(Corrupted):
            I.decode_payloads(sealed(struct.pack("<I", len(raw)) + raw, 1, b"VPLD"))
    with pytest.raises(InvalidPointId):
        I.encode_ids([""])


RECORDS = [I.Record(I.UPSERT, ("é",), (1.5, -2.0), PAYLOAD), I.Record(I.DELETE, ("a", "b")), I.Record(I.DELETE), I.Record(I.CHECKPOINT), I.Record(I.SEAL_V1, segment_id=3), I.Record(I.SEAL_V2, segment_id=4, row_count=9, crcs=(1, 2, 3))]


def test_log():
    data = b"".join(map(I.encode_record, RECORDS))
    assert I.decode_log(data) == ([RECORDS[0].__class__(I.UPSERT, ("é",), (1.5, -2.0), PAYLOAD), *RECORDS[1:]], len(data))
    for cut in range(len(data) - 1, len(data) - 40, -1):  # the last record is torn
        records, at = I.decode_log(data[:cut])
        assert len(records) == 5 and at <= cut
    first = len(I.encode_record(RECORDS[0]))
    for i in range(4, first):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(Corrupted):
            I.decode_log(bytes(bad))
    for frame in (struct.pack("<I", 4), struct.pack("<I", (16 << 20) + 1), struct.pack("<I", 5) + b"\x09" + struct.pack("<I", zlib.crc32(b"\x09")), struct.pack("<I", 6) + b"\x03x" + struct.pack("<I", zlib.crc32(b"\x03x"))):
        with pytest.raises(Corrupted):
            I.decode_log(frame)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_noise_never_crashes(data):
    for decode in (I.decode_log, I.decode_vectors, I.decode_ids, I.decode_payloads):
        try:
            decode(data)
        except Corrupted:
            pass


def test_a_store_as_tables(spark, tmp_path):
    base = tmp_path / "collections/notes"
    I.write_segment(base / "segments/1", 1, 2, [("a", [1.0, 1.0], PAYLOAD), ("b", [2.0, 2.0], {})])
    I.write_segment(base / "segments/2", 2, 2, [("b", [3.0, 3.0], {})], ["a"])
    I.write_segment(base / "segments/9", 9, 2, [("orphan", [0.0, 0.0], {})])
    (base / "segments/2/x.tmp").write_text("x")
    (base / "MANIFEST.json").write_text(json.dumps({"formatVersion": 1, "generation": 2, "segmentIds": [1, 2], "walEpoch": 2}))
    (base / "wal").mkdir()
    log = [I.Record(I.UPSERT, ("old",), (0.0, 0.0), {}), I.Record(I.SEAL_V2, segment_id=2, row_count=1), I.Record(I.UPSERT, ("c",), (4.0, 4.0), PAYLOAD), I.Record(I.DELETE, ("b", "x"))]
    (base / "wal/wal.log").write_bytes(b"".join(map(I.encode_record, log)) + b"\x30\0\0\0torn")
    root = f"file://{tmp_path}"
    db = F.lit("db").alias("db_id")
    segments, wal, manifests = (t.select(db, "*") for t in (I.read_segments(spark, root), I.read_log(spark, root), I.read_manifests(spark, root)))
    live = {r["id"]: (r["vector"], r["payload"]) for r in C.live_points(wal, segments, manifests).collect()}
    assert set(live) == {"c"} and live["c"][0] == [4.0, 4.0] and live["c"][1]["n"]["i"] == 1
    data = bytearray((base / "segments/1/IDS.bin").read_bytes())
    data[18] ^= 1
    (base / "segments/1/IDS.bin").write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        I.read_segments(spark, root).collect()


def binary_store(path):
    from pointlake.types import Metric

    (path / "collections/notes").mkdir(parents=True)
    I.write_segment(path / "collections/notes/segments/1", 1, 2, [("a", [1.0, 0.0], PAYLOAD), ("b", [2.0, 0.0], {}), ("c", [3.0, 0.0], {})])
    I.write_segment(path / "collections/notes/segments/2", 2, 2, [("b", [5.0, 0.0], {})], ["c"])
    I.write_segment(path / "collections/notes/segments/9", 9, 2, [("orphan", [5.0, 0.0], {})])
    docs = {"DB_META.json": {"config": {}}, "CATALOG.json": {"collections": {"notes": "collections/notes", "none": "collections/none"}},
            "collections/notes/COLL_META.json": {"config": {"name": "notes", "dimension": 2, "metric": Metric.L2.value, "index": "flat", "normalizeVectors": False}, "nextSegmentId": 10},
            "collections/none/COLL_META.json": {"config": {"name": "none", "dimension": 3, "metric": "cosine", "index": "flat", "normalizeVectors": True}, "nextSegmentId": 1},
            "collections/notes/MANIFEST.json": {"generation": 4, "segmentIds": [1, 2], "walEpoch": 2}}
    for name, d in docs.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(json.dumps({"formatVersion": 1} | d))
    (path / "collections/notes/wal").mkdir()
    return path


def test_a_whole_store_is_imported(spark, tmp_path):
    from pointlake.plans.database import Database
    from pointlake.sources.files import Place
    from pointlake.types import SearchRequest

    root = binary_store(tmp_path / "binary")
    log = Place(root / "collections/notes/wal/wal.log")
    assert I.append_log(log, [I.Record(I.UPSERT, ("d",), (9.0, 0.0), {}), I.Record(I.DELETE, ("a",))]) == 2
    with open(root / "collections/notes/wal/wal.log", "ab") as f:
        f.write(b"\x40\0\0\0\1torn")
    assert I.append_log(log, [I.Record(I.CHECKPOINT)]) == 3 and len(I.decode_log(log.read_bytes())[0]) == 3  # over the torn tail
    db = Database.imported(spark, str(root), str(tmp_path / "own"))
    assert db.list_collections() == ["none", "notes"] and db.collection("none").count() == 0
    for c in (db.collection("notes"), Database.open(spark, str(tmp_path / "own")).collection("notes")):
        assert [(s.id, s.distance) for s in c.search(SearchRequest([0.0, 0.0], 9))] == [("b", 5), ("d", 9)]
    for name, change in (("CATALOG.json", {"collections": {"notes": "collections/none"}}), ("DB_META.json", {"formatVersion": 7})):
        bad = binary_store(tmp_path / name)
        d = json.loads((bad / name).read_text())
        (bad / name).write_text(json.dumps(d | change))
        with pytest.raises(Corrupted):
            Database.imported(spark, str(bad))
