"""Nested boxes and item locations: long and open lengths, broken ones, short files, empty tables."""

from tessera.sources import streams


def raw(name: str, body: bytes = b"", size: int | None = None) -> bytes:
    return (8 + len(body) if size is None else size).to_bytes(4, "big") + name.encode() + body


def test_lengths_of_all_kinds(spark):
    inner = raw("ipco", raw("ispe", b"1234") + raw("colr"))
    files = {
        1: raw("ftyp", b"heic") + raw("meta", b"\0\0\0\0" + raw("hdlr") + raw("iprp", inner)) + raw("mdat", b"xyz", 0),
        2: (1).to_bytes(4, "big") + b"mdat" + (20).to_bytes(8, "big") + b"abcd" + raw("free"),
        3: raw("ftyp", b"", 4) + raw("mdat"),
        4: raw("meta", b"\0\0\0\0" + raw("iprp", b"", 99)) + raw("mdat", b"q"),
        5: b"short", 6: b"", 7: None,
    }
    table = spark.createDataFrame([(k, v.hex().upper() if v is not None else None) for k, v in files.items()], "id long, data string")
    got = {}
    for r in streams.box_tree(table, "id", "data").collect():
        got.setdefault(r.id, []).append((r.path, r.parent, r.name, r.start, r.end, r.error))
    assert [p for p, *_ in sorted(got[1])] == ["0", "1", "1/0", "1/1", "1/1/0", "1/1/0/0", "1/1/0/1", "2"]
    assert [b for b in got[1] if b[2] == "mdat"][0][4] == len(files[1])
    assert sorted(got[2]) == [("0", None, "mdat", 16, 20, None), ("1", None, "free", 28, 28, None)]
    assert got[3] == [("0", None, None, 0, 16, "broken length")]
    assert sorted(got[4]) == [("0", None, "meta", 8, 20, None), ("0/0", "0", None, 12, 20, "broken length"), ("1", None, "mdat", 28, 29, None)]
    assert set(got) == {1, 2, 3, 4}
    assert streams.box_tree(table.limit(0), "id", "data").collect() == []


def test_extents(spark):
    place = lambda item, *extents: item.to_bytes(2, "big") + b"\0\0" + len(extents).to_bytes(2, "big") + b"".join(o.to_bytes(2, "big") + n.to_bytes(1, "big") for o, n in extents)
    head = b"\0\0\0\0\x21\0" + (2).to_bytes(2, "big")
    body = head + place(7, (0, 0)) + place(8, (0, 0), (0, 0))
    start = 8 + 4 + 8 + len(body) + 8
    body = head + place(7, (start, 3)) + place(8, (start + 3, 2), (start + 3, 90))
    data = raw("meta", b"\0\0\0\0" + raw("iloc", body)) + raw("mdat", b"abcde")
    table = spark.createDataFrame([(1, data.hex().upper()), (2, raw("mdat", b"no table").hex())], "id long, data string")
    got = streams.item_extents(table, streams.box_tree(table, "id", "data"), "id", "data").collect()
    assert sorted((r.item, r.extent, bytes.fromhex(r.payload or ""), r.error) for r in got) == [(7, 0, b"abc", None), (8, 0, b"de", None), (8, 1, b"", "outside of the data")]
