"""Files of any length, digested and compared by byte ranges on disk, against contents in rows and plain versions."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from tests.test_operators import groups
from twinsift.functions import fingerprints
from twinsift.operators import exact
from twinsift.plans import scan
from twinsift.plans.matching import matching
from twinsift.sources import contents
from twinsift.sources.inventory import read_inventory


def tree(folder, seed, n=40):
    """Files of few contents, lengths around the ends of ranges and of sample windows, one byte changed in some."""
    r = random.Random(seed)
    base = [r.randbytes(k) for k in (0, 1, 99, 100, 101, 250, 200_000)]
    for k in range(n):
        data = bytearray(r.choice(base))
        if data and r.random() < 0.3:
            data[r.choice([0, len(data) // 3, len(data) - 1])] ^= 1
        place = folder / f"d{k % 4}"
        place.mkdir(exist_ok=True)
        (place / f"f{k}").write_bytes(data)


def folded(data, length, fold):
    each = [hashlib.sha256(data[i : i + length]).hexdigest() for i in range(0, max(1, len(data)), length)]
    while len(each) > 1:
        each = [g[0] if len(g) == 1 else hashlib.sha256("".join(g).encode()).hexdigest() for g in (each[i : i + fold] for i in range(0, len(each), fold))]
    return each[0]


def test_files_on_disk_give_the_groups_of_contents_in_rows(spark, tmp_path):
    tree(tmp_path, 5)
    read = lambda content: read_inventory(spark, [str(tmp_path)], content=content)[0]
    on_disk, issues = read(False), []
    assert "content" not in on_disk.columns
    for want in (matching(), matching("folder", evidence="bytes")):
        rows, disk = read(True).withColumn("root", F.lit("/")), on_disk.withColumn("root", F.lit("/"))
        in_rows = exact.duplicate_groups(rows, want)
        assert groups(exact.duplicate_groups(disk, want, issues)) == groups(in_rows) != []
    assert sum(i.count() for i in issues) == 0
    moved = exact.duplicate_groups(on_disk)._jdf.queryExecution().toString()
    assert "content" not in moved
    ask = scan.Request(("folders",))
    found = [scan._folders(scan.Inventory(f, *read_inventory(spark, [str(tmp_path)])[1:]), ask) for f in (read(True), on_disk)]
    assert groups(found[0]) == groups(found[1])


def test_digests_are_folded_range_by_range(spark, tmp_path, monkeypatch):
    tree(tmp_path, 6, 12)
    found, _, _ = read_inventory(spark, [str(tmp_path)])
    monkeypatch.setattr(contents, "FOLD", 3)
    data = {str(p): p.read_bytes() for p in tmp_path.rglob("f*")}
    got = {r.path: r.digest for r in contents.digests(found, 1000).collect()}
    assert got == {p: folded(d, 1000, 3) for p, d in data.items()}
    rows = spark.createDataFrame([(p, bytearray(d)) for p, d in data.items()], "path string, content binary")
    got = {r.path: r.d for r in rows.select("path", fingerprints.file_digest(F.col("content"), 100).alias("d")).collect()}
    assert got == {p: folded(d, 100, 1 << 20) for p, d in data.items()}
    back = {}
    for r in contents.chunks(found, 70_000).collect():
        back.setdefault(r.path, {})[r.chunk] = bytes(r.content)
    assert {p: b"".join(c[k] for k in sorted(c)) for p, c in back.items()} == data


def test_a_file_beyond_the_limit_of_a_row(spark, tmp_path):
    """Files of more than 2 GiB, without blocks on disk: two are equal, one differs past the limit and between the windows."""
    for name in "abc":
        with open(tmp_path / name, "wb") as f:
            f.truncate((1 << 31) + 500_000)
            if name == "c":
                f.seek((1 << 31) + 100_000)
                f.write(b"x")
    found, _, _ = read_inventory(spark, [str(tmp_path)])
    got = exact.duplicate_groups(found)
    assert groups(got) == [[f"{tmp_path}/a", f"{tmp_path}/b"]]
    assert [r.status for r in exact.summarize(got).collect()] == ["Exact match"]


def test_files_that_differ_under_one_digest_part_and_changed_ones_are_told(spark, tmp_path):
    for name, data in {"a": b"first!", "b": b"first!", "c": b"second", "d": b"second", "e": b"third!", "f": b"first!"}.items():
        (tmp_path / name).write_bytes(data)
    found, _, _ = read_inventory(spark, [str(tmp_path)])
    found = spark.createDataFrame(found.collect(), found.schema)
    (tmp_path / "f").write_bytes(b"first!")
    os.utime(tmp_path / "f", ns=(1, 1))
    issues, short = [], lambda p: p.rsplit("/", 1)[1]
    members = found.select("path", F.lit(f"{tmp_path}/a").alias("group_id"))
    got = {(short(r.path), short(r.group_id)) for r in exact.verified(members, found, issues).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")}
    assert {short(r.path) for i in issues for r in i.collect()} == {"f"}
    issues = []
    (tmp_path / "b").unlink()
    assert [[short(p) for p in g] for g in groups(exact.duplicate_groups(found, None, issues))] == [["c", "d"]]
    assert {short(r.path) for i in issues for r in i.collect()} == {"b", "f"}


def test_a_popular_content_is_folded_before_it_moves(spark):
    rows = spark.range(4000).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 2 == 0, F.lit(b"a" * 50)).otherwise(F.lit(b"b" * 50)).alias("content")).withColumn("size", F.lit(50).cast("long"))
    got = exact.duplicate_groups(rows)
    assert {(r.group_id, r["count"]) for r in got.groupBy("group_id").count().collect()} == {("/0", 2000), ("/1", 2000)}
    long = spark.createDataFrame([("/a", bytearray(b"q" * 9_000_000)), ("/b", bytearray(b"q" * 8_999_999 + b"r"))], "path string, content binary")
    parted = exact.verified(long.select("path", F.lit("/a").alias("group_id")), long)
    assert {(r.path, r.group_id) for r in parted.collect()} == {("/a", "/a"), ("/b", "/b")}
