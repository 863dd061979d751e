"""Operators on generated inventories against plain versions, and small cases of scopes, reviews and plans."""

import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import registry
from twinsift.functions import fingerprints, paths
from twinsift.operators.graph import cut
from twinsift.operators import cleanup, exact, folders, neighbours, review, scope, similar, tolerance
from twinsift.plans import scan
from twinsift.plans.matching import matching
from twinsift.scratch import shared_folder

RECORD = "path string, content binary, size long, modified_ns long, created_ns long, device long, inode long, root string"


def files(spark, **contents):
    rows = []
    for k, (path, data) in enumerate(contents.items()):
        data, when = data if isinstance(data, tuple) else (data, 0)
        rows.append((path, bytearray(data), len(data), when, when, 1, k, "/"))
    return spark.createDataFrame(rows, RECORD)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_id, set()).add(r.path)
    return sorted(map(sorted, out.values()))


def edits(a, b):
    """Edit distance by whole rows."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def first_fit(rows, fits):
    """Each row joins the first group all of whose members it fits."""
    found = []
    for x in rows:
        for g in found:
            if all(fits(x, y) for y in g):
                g.append(x)
                break
        else:
            found.append([x])
    return found


def inventory(seed, n=70):
    """{path: (content, time)}: few names, endings, folders, contents and times, so that all of them repeat."""
    r = random.Random(seed)
    out = {}
    while len(out) < n:
        stem = "".join(r.choice("kw") for _ in range(r.randint(1, 4)))
        mark = r.choice(["", "", "", "Copy of ", "copy - "])
        end = r.choice(["", "", " - Copy", " copy (7)"]) if not mark else ""
        path = f"/{r.choice('uv')}/{r.choice(['Deep/', 'deep/', ''])}{mark}{r.choice([stem, stem.upper()])}{end}{r.choice(['.q', '.Q', '.zz', ''])}"
        out[path] = (bytes([r.randrange(2)]) * r.choice([0, 1, 3, 4, 9, 11]), r.randrange(3) * 40_000 * 10**9)
    return out


def plain_groups(contents, key=lambda p, data, when: (), order=None, fits=None, several=False):
    """Rows that share a key, fitted in order if ``fits`` says what goes together."""
    by = {}
    for p, (data, when) in contents.items():
        by.setdefault(key(p, data, when), []).append(p)
    out = []
    for own in by.values():
        parts = [own] if fits is None else first_fit(sorted(own, key=order), fits)
        out += [sorted(g) for g in parts if len(g) > 1 and (not several or len({q.rsplit("/", 1)[0] for q in g}) > 1)]
    return sorted(out)


def base(p):
    return p.rsplit("/", 1)[1]


def parted(p):
    """(stem, ending)"""
    n = base(p)
    at = n.rfind(".")
    return (n[:at], n[at:]) if at > 0 else (n, "")


def unmarked(p):
    stem, end = parted(p)
    stem = re.sub(r"^copy(\s+of)?[\s_-]+", "", stem, flags=re.I)
    return re.sub(r"[\s_-]+copy(\s*\(\d+\))?$", "", stem, flags=re.I) + end


RULES = {
    "contents": ([], {}, dict(key=lambda p, data, when: data)),
    "contents in several folders": ([], {"several_folders": True}, dict(key=lambda p, data, when: data, several=True)),
    "digests alone": (["size~4"], {"evidence": "digest"}, dict(key=lambda p, data, when: data)),
    "sizes": (["size"], {"evidence": ""}, dict(key=lambda p, data, when: len(data))),
    "names": (["name"], {"evidence": ""}, dict(key=lambda p, data, when: base(p).lower())),
    "cased names": (["name cased"], {"evidence": ""}, dict(key=lambda p, data, when: base(p))),
    "unmarked names": (["name unmarked"], {"evidence": ""}, dict(key=lambda p, data, when: unmarked(p).lower())),
    "names and contents": (["name"], {}, dict(key=lambda p, data, when: (base(p).lower(), data))),
    "endings, times and contents": (["ending", "changed"], {}, dict(key=lambda p, data, when: (parted(p)[1].lower(), when, data))),
    "days": (["changed day"], {"evidence": ""}, dict(key=lambda p, data, when: when // (86_400 * 10**9))),
    "whole folders": (["folder whole"], {"evidence": "bytes"}, dict(key=lambda p, data, when: (p.rsplit("/", 1)[0].lower(), data))),
    "near names": (["name~1"], {"evidence": ""}, dict(order=lambda p: (p.casefold(), p), fits=lambda p, q: edits(base(p).lower(), base(q).lower()) <= 1)),
    "near names of equal contents": (["name~2"], {"evidence": "bytes"}, dict(key=lambda p, data, when: data, order=lambda p: (p.casefold(), p), fits=lambda p, q: edits(base(p).lower(), base(q).lower()) <= 2)),
}


@pytest.mark.parametrize("rule", RULES)
def test_groups_by_rule(spark, rule):
    same, options, of = RULES[rule]
    contents = inventory(len(rule))
    want = plain_groups(contents, **of)
    assert groups(exact.duplicate_groups(files(spark, **contents), matching(*same, **options))) == want and want


@pytest.mark.parametrize("names", [False, True])
def test_near_sizes(spark, names):
    """Sizes alone, and names and sizes together: smaller files come first, and nothing chains."""
    contents = inventory(31 + names)
    near = lambda p, q: abs(len(contents[p][0]) - len(contents[q][0])) <= 2
    if names:
        want = plain_groups(contents, order=lambda p: (len(contents[p][0]), p.casefold(), p), fits=lambda p, q: near(p, q) and edits(base(p).lower(), base(q).lower()) <= 2)
    else:
        want = plain_groups(contents, order=lambda p: len(contents[p][0]), fits=lambda p, q: near(p, q))
    got = exact.duplicate_groups(files(spark, **contents), matching(*(["name~2"] if names else []), "size~2", evidence=""))
    assert groups(got) == want and want


def test_equal_digests_of_other_bytes_part(spark):
    f = files(spark, **{"/a": b"first!", "/b": b"first!", "/c": b"second", "/d": b"second", "/e": b"third!"})
    members = f.select("path", F.lit("/a").alias("group_id"))
    got = exact.verified(members, f)
    assert {(r.path, r.group_id) for r in got.collect()} == {("/a", "/a"), ("/b", "/a"), ("/c", "/c"), ("/d", "/c"), ("/e", "/e")}


def test_files_without_a_time_of_creation_are_told(spark):
    f = files(spark, **{"/a": b"x", "/b": b"x"}).withColumn("created_ns", F.when(F.col("path") == "/a", F.col("created_ns")))
    want = matching("born")
    assert exact.duplicate_groups(f, want).count() == 0 and [tuple(r) for r in want.unusable(f).collect()] == [("/b", "no time of creation")]


def test_verification_is_told(spark):
    f = files(spark, **{"/a": b"aaa", "/b": b"aaa", "/c": b"bbb"})
    told = lambda evidence: [(r.status, r.digest is not None) for r in exact.summarize(exact.duplicate_groups(f, matching("size", evidence=evidence))).collect()]
    assert told("digest bytes") == [("Exact match", True)]
    assert told("digest") == [("Hash match — bytes not verified", True)]
    assert told("bytes") == [("Exact match", False)]
    assert told("") == [("Possible match — contents not verified", False)]


def test_sample_and_digest_stages_part_what_differs_between_windows(spark):
    a = bytearray(655_360)
    b = bytearray(a)
    b[131_072] = 1
    assert groups(exact.duplicate_groups(files(spark, **{"/a": bytes(a), "/b": bytes(b)}))) == []


def test_criteria_are_checked():
    assert str(matching("name~2 unmarked cased", "folder 3 below", evidence="bytes")) == "folder below 3; name~2 cased unmarked; bytes"
    for bad in ([], ["size~-1"], ["name~x"], ["colour"], ["size cased"], ["ending~2"], ["folder 0"], ["name 2"], ["size", "size~3"]):
        with pytest.raises(ValueError):
            matching(*bad, evidence="")
    with pytest.raises(ValueError):
        matching(evidence="hearsay")
    with pytest.raises(ValueError):
        paths.check_file_types(["Nonsense"])


def test_names(spark):
    rows = [("/d/.bashrc", "", ".bashrc"), ("/a.tar.gz", ".gz", "a.tar"), ("/a.", "", "a."), ("/..x", ".x", "."), ("/x/b.JPG", ".JPG", "b")]
    df = spark.createDataFrame(rows, "path string, suffix string, stem string")
    assert df.where((paths.suffix(F.col("path")) != F.col("suffix")) | (paths.stem(F.col("path")) != F.col("stem"))).count() == 0
    fold = spark.createDataFrame([("Straße",), ("STRASSE",), ("ΣΑΣ",), ("ﬁ",), ("İ",), ("ı",)], "t string").select("t", paths.casefold(F.col("t")).alias("k")).collect()
    assert all(r.k == r.t.casefold() for r in fold)


def test_edit_distance(spark):
    r = random.Random(17)
    word = lambda: "".join(r.choice("mnö") for _ in range(r.randint(0, 6)))
    pairs = [(word(), word(), k) for k in range(4) for _ in range(60)]
    for k in range(4):
        df = spark.createDataFrame([p[:2] for p in pairs if p[2] == k], "a string, b string")
        got = [r.near for r in df.select(paths.similar_text(F.col("a"), F.col("b"), k).alias("near")).collect()]
        assert got == [edits(a, b) <= k for a, b, of in pairs if of == k]


def test_near_names_miss_nothing(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(120)})
    for k in (0, 1, 2, 3):
        got = {tuple(x) for x in tolerance.near_names(spark.createDataFrame([(n,) for n in names], "name string"), k).collect()}
        assert got == {(a, b) for a in names for b in names if a < b and edits(a, b) <= k}


@pytest.mark.parametrize("keys, tolerance_", [([], 0), ([], 6), ([], 5_000), (["key"], 6)])
def test_anchors_against_a_plain_sweep(spark, keys, tolerance_):
    """Blocks of the order, few and many sizes a step; a null key is a key, and repeated sizes cost nothing."""
    r = random.Random(tolerance_)
    rows = [(r.choice(["x", "y", None]) if keys else "x", r.randrange(2_000)) for _ in range(600)] + [("x", 77)] * 50
    want, by = set(), {}
    for k, size in rows:
        by.setdefault(k, set()).add(size)
    for k, sizes in by.items():
        anchor = None
        for size in sorted(sizes):
            anchor = size if anchor is None or size - anchor > tolerance_ else anchor
            want.add((k, size, anchor))
    got = tolerance.size_anchors(spark.createDataFrame(rows, "key string, size long"), keys, "size", tolerance_)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(rows)
    assert "SinglePartition" not in got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("large", [0, 10**6])
def test_names_are_fitted_alike_in_one_task_and_in_rounds(spark, large):
    r = random.Random(9)
    rows = [(f"/f/{k}", "".join(r.choice("cd") for _ in range(r.randint(2, 4))), r.randrange(6), r.choice(["left", None])) for k in range(30)] + [(f"/g/{k}", "same", 3, "left") for k in range(40)]
    want = set()
    for side in ("left", None):
        own = sorted((x for x in rows if x[3] == side), key=lambda x: (x[2], x[0]))
        for g in first_fit(own, lambda x, y: abs(x[2] - y[2]) <= 2 and edits(x[1], y[1]) <= 1):
            if len(g) > 1:
                want |= {(side, x[0], min(y[0] for y in g)) for x in g}
    df = spark.createDataFrame(rows, "path string, name_key string, size long, side string")
    assert {tuple(x) for x in tolerance.similar_name_groups(df, ["side"], 1, 2, large=large).collect()} == want and want


def test_dates_and_folders(spark):
    ns = lambda d, h: (d * 86400 + h * 3600) * 10**9
    rows = spark.createDataFrame([(ns(1, 8),), (ns(1, 22),), (ns(2, 8),)], "t long")
    assert len({r[0] for r in rows.select(paths.date_key(F.col("t"), True)).collect()}) == 2
    assert len({r[0] for r in rows.select(paths.date_key(F.col("t"), False)).collect()}) == 3
    at = ["/one/two/Three/x", "/one/two/three/y", "/one/four/Three/x", "/zero/two/three/z", "/one/w"]
    p = spark.createDataFrame([(x, "/" + x.split("/")[1]) for x in at], "path string, root string")
    inside = [x.split("/")[1:-1] for x in at]
    same = lambda values: [[a == b for a in values] for b in values]
    keys = lambda **k: same([r[0] for r in p.select(paths.folder_key(F.col("path"), F.col("root"), **k)).collect()])
    lower = [[x.lower() for x in f] for f in inside]
    assert keys() == same([f[-1] for f in lower])
    assert keys(full=True) == same(lower) and keys(full=True, case_sensitive=True) == same(inside)
    assert keys(from_root=True) == same([f[1:] for f in lower])
    assert keys(from_root=True, depth_limit=1) == same([(len(f) > 1, f[1:2]) for f in lower])


def with_ids(spark, contents):
    rows = [(p, len(c), c) for p, c in contents.items()]
    return spark.createDataFrame(rows, "path string, size long, content_id string")


def plain_folders(contents, lone=(), bad=(), roots=None):
    """Groups of folders whose trees hold equal multisets, dealt so that none lies within another; empty ones by themselves."""
    up = lambda p: ["/".join(p.split("/")[:k]) for k in range(2, p.count("/") + 1)]
    trees, dirs = {}, {}
    for p in [*contents, *(f"{d}/" for d in lone)]:
        for f in up(p):
            trees.setdefault(f, [])
            if not p.endswith("/"):
                trees[f].append(contents[p])
    for f in trees:
        for a in [*up(f), f]:
            dirs.setdefault(a, set()).add(f)
    closed = {a for p in bad for a in [*up(p), p]}
    equal = {}
    for f, held in trees.items():
        if f not in closed and (roots is None or f in roots):
            equal.setdefault(tuple(sorted(held)), []).append(f)
    out = []
    for held, found in equal.items():
        levels = {}
        for f in found:
            levels.setdefault(sum(a in found for a in up(f)), []).append(f)
        out += [sorted(g) for g in levels.values() if len(g) > 1 or (not held and min(len(dirs[f]) for f in g) == 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_folders_against_a_plain_version(spark, seed):
    """Small random trees whose folders repeat, nest, are empty, or hold something unreadable."""
    r = random.Random(seed)
    folders_ = ["/" + "/".join(r.choice("mn") for _ in range(r.randint(1, 4))) for _ in range(14)]
    contents = {f"{r.choice(folders_)}/file{k}": r.choice(["p", "qq"]) for k in range(12)}
    lone = [f"{r.choice(folders_)}/none{k}" for k in range(3)]
    bad = [f"{r.choice(folders_)}/broken"] if seed % 2 else []
    roots = sorted({p.rsplit("/", 1)[0] for p in contents}) if seed == 2 else None
    given = spark.createDataFrame([(d,) for d in lone], "path string")
    issues = spark.createDataFrame([(d,) for d in bad], "path string")
    got = folders.duplicate_folders(with_ids(spark, contents), given, issues, roots)
    assert groups(got) == plain_folders(contents, lone, bad, roots)
    sums = {x.path: (x.n_files, x.total_size) for x in folders.rollup(with_ids(spark, contents), given).collect()}
    for f, (n, size) in sums.items():
        own = [c for p, c in contents.items() if p.startswith(f.rstrip("/") + "/")]
        assert (n, size) == (len(own), sum(map(len, own)))


def test_empty_folders(spark):
    dirs = spark.createDataFrame([("/r",), ("/r/a",), ("/r/b",)], "path string")
    entries = spark.createDataFrame([("/r/a",), ("/r/b",), ("/r/b/.hidden",)], "path string")
    assert [r.path for r in folders.empty_folders(dirs, entries, ["/r"]).collect()] == ["/r/a"]


def test_images(spark):
    images = lambda *rows: spark.createDataFrame(list(rows), "path string, width int, height int, signature long")
    got = similar.image_groups(images(("a", 300, 200, 0), ("b", 300, 200, 15), ("c", 300, 200, 255)), 4).collect()
    assert [tuple(r) for r in got] == [("a", "b", 4)]
    assert similar.image_groups(images(("a", 300, 200, 0), ("b", 200, 300, 0)), 12).count() == 0
    r = random.Random(2)
    values = [r.getrandbits(63) for _ in range(60)]
    values += [v ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for v in values] + values[:5]
    rows = [(f"p{k:03}", r.choice((300, 600)), r.choice((200, 400)), v) for k, v in enumerate(values)]
    for radius in (0, 4, 8):
        refs, want = [], set()
        for p, w, h, s in sorted(rows, key=lambda x: (-x[1] * x[2], x[0])):
            import math

            near = [((s ^ q[3]).bit_count(), k) for k, q in enumerate(refs) if (s ^ q[3]).bit_count() <= radius and abs(math.log(w * q[2] / (h * q[1]))) <= 0.08]
            if near:
                d, k = min(near)
                want.add((refs[k][0], p, d))
            else:
                refs.append((p, w, h, s))
        assert {tuple(x) for x in similar.image_groups(images(*rows), radius).collect()} == want


def test_hamming_neighbours_of_every_plan(spark):
    """No pair within the radius is missed, and none meets twice in a band, whatever the number of bands."""
    r = random.Random(6)
    bits = 21
    values = sorted({r.getrandbits(bits) for _ in range(150)} | {0, (1 << bits) - 1})
    df = spark.createDataFrame([(v,) for v in values], "signature long")
    for radius in (0, 3, 6):
        want = {(a, b, (a ^ b).bit_count()) for a in values for b in values if (a ^ b).bit_count() <= radius}
        assert {tuple(x) for x in neighbours.hamming_pairs(df, df, radius, bits=bits).collect()} == want
        for n in range(1, radius + 2):
            bands = neighbours.bands_of(radius, bits, n)
            assert sum(b.within + 1 for b in bands) > radius and sum(b.width for b in bands) == bits
            if bands[0].width <= 11:
                met = Counter(tuple(x) for x in neighbours.meetings(df, df, bands).collect())
                assert {p[:2] for p in want} <= met.keys() and max(met.values()) <= n


def test_hamming_neighbours_move_no_pairs(spark):
    """Signatures of which all share most bits, over several blocks: each moves once per block, and only pairs within the radius leave a task."""
    r = random.Random(7)
    left, right = (sorted({r.getrandbits(12) << 40 | 5 for _ in range(300)}) for _ in range(2))
    a, b = (spark.createDataFrame([(v,) for v in x], "signature long") for x in (left, right))
    for one, other, x, y in ((a, b, left, right), (a, a, left, left)):
        want = sorted((p, q, (p ^ q).bit_count()) for p in x for q in y if (p ^ q).bit_count() <= 2)
        found = neighbours.hamming_pairs(one, other, 2)
        assert sorted(tuple(p) for p in found.collect()) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Distinct" not in plan


def test_few_pairs_meet_at_wide_radii():
    """Of many signatures less than a fiftieth of all pairs meet, at every radius in use."""
    for radius in sorted({*similar.IMAGE_RADII.values(), *(p[0] for p in similar.VIDEO_PRESETS.values())}):
        bands = neighbours.plan_bands(radius, 63, 10**6, 10**6)
        assert sum(b.met() for b in bands) < 0.02
        for b in bands:
            if b.count(False) < 3_000:
                assert (len(list(b.probes(True))), len(list(b.probes(False)))) == (b.count(True), b.count(False))


def test_cells_compare_values_in_columns(monkeypatch):
    """Repeated signatures, a value that many share and few rows at a time: each pair within the radius comes once, and a value is looked up once for all rows that have it."""
    monkeypatch.setattr(neighbours, "AT_ONCE", 64)
    rng = np.random.default_rng(8)
    a, b = (np.concatenate([rng.integers(0, 1 << 18, 150), np.full(40, 5), rng.integers(0, 8, 40) << 15 | 77]).astype(np.uint64) for _ in range(2))
    for n in (1, 2, 4):
        bands = neighbours.bands_of(3, 18, n)
        found = [p for x, y in neighbours.cell_pairs(a, b, bands, 3) for p in zip(x.tolist(), y.tolist())]
        near = np.argwhere(np.bitwise_count(a[:, None] ^ b[None]) <= 3)
        assert sorted(found) == sorted(map(tuple, near.tolist()))
    starts, own, places = neighbours._groups(np.repeat(np.arange(4), 1000), 2)
    assert places.shape == (16, 252) and (np.diff(starts) == 63).all() and (np.bincount(own) == 63).all()


def test_bands_hold_only_bits_that_vary(spark, monkeypatch):
    """Bits above those in which signatures differ would make bands that tell less: on either side they may be set or not, if they are alike."""
    planned, plan = [], neighbours.plan_bands
    monkeypatch.setattr(neighbours, "plan_bands", lambda radius, bits, *n: planned.append(bits) or plan(radius, bits, *n))
    table = lambda *values: spark.createDataFrame([(v,) for v in values], "signature long")
    high = 1 << 61
    some = [high | x for x in (0, 1, 3, 1 << 39)]
    both = table(*some)
    assert {tuple(x) for x in neighbours.hamming_pairs(both, both, 1).collect()} == {(x, y, (x ^ y).bit_count()) for x in some for y in some if (x ^ y).bit_count() <= 1}
    assert {tuple(x) for x in neighbours.hamming_pairs(table(0, 1), table(high, high | 3), 2).collect()} == {(0, high, 1), (1, high, 2), (1, high | 3, 2)}
    assert neighbours.hamming_pairs(table(7), table(), 2).isEmpty() and neighbours.hamming_pairs(table(7), table(7), 2).count() == 1
    assert planned == [40, 62, 1, 1]


@pytest.mark.parametrize("preset", similar.VIDEO_PRESETS)
def test_videos(spark, preset):
    """Frames that differ by as many bits as the preset allows, or by one more, in as many slots as it asks for, or one fewer."""
    radius, required, _ = similar.VIDEO_PRESETS[preset]
    r = random.Random(radius)
    first = [r.getrandbits(63) for _ in range(24)]

    def changed(bits, slots=12):
        flip = lambda s, n: s ^ sum(1 << b for b in r.sample(range(63), n))
        return [flip(s, bits if k // 2 < slots else 31) for k, s in enumerate(first)]

    rows = [("m", 640, 360, 50.0, first), ("n-near", 640, 360, 50.2, changed(radius)), ("n-far", 640, 360, 50.0, changed(radius + 1)), ("o-few", 640, 360, 50.0, changed(radius, required - 1)), ("o-enough", 640, 360, 50.0, changed(0, required)), ("p-long", 640, 360, 61.0, first), ("p-tall", 360, 640, 50.0, first), ("q-blank", 640, 360, 50.0, [None] * 24)]
    df = spark.createDataFrame(rows, "path string, width int, height int, duration double, signatures array<long>")
    # a far frame may come near by chance only where slots have four pairs; with these draws none does
    found = {(x.reference, x.path) for x in similar.video_groups(df, preset).collect()}
    assert ("m", "n-near") in found and not any({"p-long", "p-tall", "q-blank", "n-far", "o-few"} & set(p) for p in found)
    assert (("m", "o-enough") in found) == (required >= 10)  # with nine slots the last third has one only


def test_video_links_of_every_pair(spark):
    """Links against a plain reading of all pairs: durations at the borders of cells, frames that many share, frames that are missing."""
    r = random.Random(11)
    popular = [r.getrandbits(60) for _ in range(3)]
    rows = []
    for k in range(70):
        duration = r.choice([0.2, 0.45, 16.6, 16.7, 16.9, 100.0, 101.4, 101.6, 333.3, 338.3, 338.4]) + r.choice([0, 0.0, 0.24])
        shared = popular[k % 3]
        frames = [r.choice([shared, shared ^ r.getrandbits(4), None, shared]) if k % 4 else r.choice(popular) for _ in range(24)]
        rows.append((k, r.choice([320, 330, 640]), 180, duration, frames))
    nodes = cut(spark.createDataFrame(rows, "node long, width int, height int, duration double, signatures array<long>"))
    every = nodes.alias("x").crossJoin(nodes.alias("y"))
    for preset, (radius, required, tolerance) in similar.VIDEO_PRESETS.items():
        e = similar.slot_evidence(F.col("y.signatures"), F.col("x.signatures"), radius)
        near = similar.near_durations(F.col("x.duration"), F.col("y.duration"), tolerance) & similar.same_aspect(F.col("y.width"), F.col("y.height"), F.col("x.width"), F.col("x.height"))
        plain = every.where(near).withColumn("e", e).where((F.col("e.matched") >= required) & (F.col("e.thirds") >= 2)).select("x.node", "y.node", "e")
        want = sorted((a, b, tuple(e)) for a, b, e in plain.collect())
        assert sorted((a, b, tuple(e)) for a, b, e in similar.video_links(nodes, nodes, preset).collect()) == want and len(want) > 70
        assert sorted((a, b, tuple(e)) for a, b, e in similar.video_links(nodes, nodes, preset, halved=True).collect()) == [x for x in want if x[1] <= x[0]]


def test_copies_of_videos_end_alike(spark, tmp_path):
    """Texts that differ in the characters beyond the last frame, or that follow another by being near it, are no copies of that one."""
    from tests.compare import connect, differences
    from twinsift import registry

    body = "".join(chr(97 + k * 7 % 26) for k in range(24 * 9))
    texts = [body + "one", body + "two", body + "two", "short", "short", body, body, None, body[:24]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(registry.QUERIES["video_copies"](spark, str(tmp_path)), con, registry.ORACLE_SQL["video_copies"]) == ""


def test_review_filters(spark):
    """Every combination of wanted and unwanted terms and bounds against a plain reading of them."""
    contents = {p: (bytes([k % 3]) * (700 * (1 + k % 3)), 0) for k, p in enumerate(["/Ab/Rst.x", "/ab/uvw.x", "/c/RST-2.y", "/c/uvw.y", "/Ab/r.z", "/d/+r.z", "/d/s.z", "/c/s, t.x", "/e/r.y"])}
    members = exact.duplicate_groups(files(spark, **contents)).cache()
    group_of = {r.path: r.group_id for r in members.collect()}
    assert len(set(group_of.values())) == 3

    def plain(name="", folder="", low=0.0, high=1e9):
        def holds(text, terms):
            for t in filter(None, map(str.strip, terms.split(","))):
                no, t = t.startswith("-"), t[1:] if t[0] in "-+" else t
                if (t.strip('"').lower() in text.lower()) == no:
                    return False
            return True

        return {group_of[p] for p, (data, _) in contents.items() if holds(base(p), name) and holds(p.rsplit("/", 1)[0], folder) and low <= len(data) <= high}

    for name in ("", " RST ", "-rst", "rst, -2", "++r", "-uvw, -s", "nothing"):
        for folder in ("", "AB", "-c", "ab, -d"):
            got = review.visible_groups(members, review.matches(file_name=name, folder=folder))
            assert {r.group_id for r in got.collect()} == plain(name, folder)
    assert {r.group_id for r in review.visible_groups(members, review.matches(file_name='"s, t"')).collect()} == {group_of["/c/s, t.x"]}
    assert {r.group_id for r in review.visible_groups(members, review.matches(bounds=review.size_bounds("1", 1, "1.5", 1))).collect()} == plain(low=1024, high=1536)
    for wrong in ("+", "-", '"r'):
        with pytest.raises(ValueError):
            review.parse_terms(wrong)
    with pytest.raises(ValueError):
        review.size_bounds("9", 1, "8", 1)
    chosen = {r.path for r in review.select_in_folder(members, spark.createDataFrame([], "path string"), "/Ab").collect()}
    assert chosen == {"/Ab/Rst.x", "/Ab/r.z"}
    members.unpersist()


def test_streams_in_plans(spark):
    ref, target = F.create_map(F.lit("x"), F.lit("1"), F.lit("only"), F.lit("2")), F.create_map(F.lit("x"), F.lit("9"))
    got = spark.range(1).select(cleanup.stream_differences(ref, target, False), cleanup.stream_differences(ref, target, True)).first()
    assert list(got) == [["x"], ["only", "x"]]


def member(group, path, digest="d", current=True, streams=None, inode=None):
    return (group, path, 1, digest, current, True, streams or {}, 1, ord(path[-1]) if inode is None else inode)


def plan(spark, members, selected, **k):
    schema = "group_id string, path string, size long, digest string, is_current boolean, contents_verified boolean, stream_map map<string,string>, device long, inode long"
    m = spark.createDataFrame(members, schema)
    s = spark.createDataFrame([(p,) for p in selected], "path string")
    return {r.path: (r.role, r.verdict) for r in cleanup.duplicate_plan(m, s, **k).collect()}


def test_duplicate_plan(spark):
    assert plan(spark, [member("g", "/a"), member("g", "/b")], ["/b"]) == {"/b": ("copy", "remove")}
    assert plan(spark, [member("g", "/a"), member("g", "/b")], ["/a", "/b"]) == {"/a": ("copy", "remove"), "/b": ("reference", "remove")}
    assert plan(spark, [member("g", "/a", "x"), member("g", "/b")], ["/a", "/b"]) == {"/a": ("copy", "keep"), "/b": ("reference", "keep")}
    assert plan(spark, [member("g", "/a", current=False), member("g", "/b")], ["/b"]) == {"/b": ("copy", "keep")}
    zone = {":Zone.Identifier:$DATA": "1"}
    assert plan(spark, [member("g", "/a"), member("g", "/b", streams=zone)], ["/b"]) == {"/b": ("copy", "keep")}
    assert plan(spark, [member("g", "/a"), member("g", "/b", streams=zone)], ["/b"], allow_zone=True) == {"/b": ("copy", "remove")}
    assert plan(spark, [member("g", "/a", streams=zone), member("g", "/b")], ["/b"]) == {"/b": ("copy", "remove")}


def test_plans_refuse_foreign_and_repeated_files(spark):
    for members, selected in (
        ([member("g", "/a"), member("g", "/b")], ["/b", "/elsewhere"]),
        ([member("g", "/a", inode=5), member("g", "/b", inode=5)], ["/b"]),
        ([member("g", "/a"), member("g", "/b"), member("h", "/b", inode=7)], ["/b"]),
    ):
        with pytest.raises(ValueError):
            plan(spark, members, selected)


def test_folder_plan(spark):
    fold = spark.createDataFrame([("g", "/a", 2, True), ("g", "/b", 2, True)], "group_id string, path string, n_files long, is_current boolean")
    now = lambda last: spark.createDataFrame([("/a/1", 1, "x"), ("/a/2", 1, "y"), ("/b/1", 1, "y"), ("/b/2", 1, last)], "path string, size long, digest string")
    chosen = spark.createDataFrame([("/b",)], "path string")
    verdict = lambda last: cleanup.folder_plan(fold, now(last), chosen).first().verdict
    assert verdict("x") == "remove" and verdict("y") == "keep"
    with pytest.raises(ValueError):
        cleanup.check_nested(spark.createDataFrame([("/b",), ("/b/c",)], "path string"))


def test_scope(spark):
    r = random.Random(3)
    given = sorted({"/" + "/".join(r.choice(["g", "gh", "h"]) for _ in range(r.randint(2, 4))) for _ in range(40)})
    f = spark.createDataFrame([(p,) for p in given], "path string")
    under = lambda p, d: p.startswith(d + "/")
    assert {x.path for x in scope.without_excluded(f, ["/g", "/h/gh"]).collect()} == {p for p in given if not under(p, "/g") and not under(p, "/h/gh") and p not in ("/g", "/h/gh")}
    starts = ["/gh", "/g", "/g/h"]
    want = {(p, max((d for d in starts if under(p, d)), key=len)) for p in given if any(under(p, d) for d in starts)}
    assert {(x.path, x.root) for x in scope.with_root(f, starts).collect() if x.path not in starts} == {x for x in want if x[0] not in starts}
    assert scope.added_roots(["/a"], ["/a", "/b", "/a/c"]) == ["/b"]
    for old, new in ((["/a"], ["/b"]), (["/a/b"], ["/a", "/a/b"]), (["/a"], ["/a", "/a/b"])):
        with pytest.raises(ValueError):
            scope.added_roots(old, new)
    with pytest.raises(ValueError):
        scope.check_scope(["/a"], ["/b"])


def test_scans_of_several_kinds(spark, tmp_path):
    f = files(spark, **{"/r/a/x.txt": b"1", "/r/b/y.txt": b"1", "/r/b/z.png": b"22"})
    broken = spark.createDataFrame([("/i/a", 1, 1)], "path string, width int, height int")
    held = scan.Inventory(f, images=broken)
    ask = scan.Request(("images", "files", "folders", "files"), file_types=("Images",))
    ledger = {r.kind: r for r in scan.run(spark, held, ask, f"file://{tmp_path}/one").collect()}
    assert {k: r.state for k, r in ledger.items()} == {"images": "failed", "files": "done", "folders": "done"} and "signature" in ledger["images"].reason
    assert ledger["files"].n_rows == 0 and ledger["folders"].n_rows == 0
    whole = files(spark, **{"/r/a/x.txt": b"1", "/r/b/y.txt": b"1"})
    ledger = scan.run(spark, scan.Inventory(whole), scan.Request(("files", "folders"), file_types=("Images",)), f"file://{tmp_path}/two")
    assert {(r.kind, r.n_rows) for r in ledger.collect()} == {("files", 0), ("folders", 2)}  # types don't thin out trees
    ask = scan.Request(("files", "images", "folders"))
    ledger = scan.run(spark, held, ask, f"file://{tmp_path}/three", together=True)
    assert {(r.kind, r.state) for r in ledger.collect()} == {("files", "taken back"), ("images", "failed"), ("folders", "skipped")} and not (tmp_path / "three/files").exists()
    stopped = scan.run(spark, held, ask, f"file://{tmp_path}/four", go_on=lambda: False)
    assert {r.state for r in stopped.collect()} == {"skipped"}
    for bad in (scan.Request(()), scan.Request(("nonsense",)), scan.Request(("videos",)), scan.Request(("files",), images="Lax")):
        with pytest.raises(ValueError):
            scan.run(spark, held, bad, f"file://{tmp_path}/five")


def test_details_and_media(spark):
    stream = [(":x:$DATA", 3)]
    rows = [("g", "/a", 1, "d", None, stream, [(":x:$DATA", "1")]), ("g", "/b", 1, "d", None, [], [])]
    m = spark.createDataFrame(rows, "group_id string, path string, size long, digest string, byte_verified boolean, streams array<struct<name:string,size:long>>, stream_hashes array<struct<name:string,sha256:string>>")
    groups_ = exact.summarize(m)
    assert groups_.first().status == "Metadata differs" and groups_.first().extra_bytes == 1
    assert {tuple(r) for r in exact.stream_states(groups_, m).collect()} == {("g", "/a", ":x:$DATA", 3, "unequal"), ("g", "/b", ":x:$DATA", None, "absent")}
    f = spark.createDataFrame([("/a.JPG",), ("/b.mp4",), ("/c.txt",)], "path string")
    assert similar.of_media(f).count() == 2 and similar.of_media(f, "Images").count() == 1
    assert tuple(similar.media_counts(f, f.limit(1)).first()) == (1, 1, 1, 1)


def test_nested_folders_hold_little_disk(spark, monkeypatch):
    """Steps leave neither shuffles, but for those of counts, nor tables that aren't read any more; folders aren't spread over all that lies above them."""
    monkeypatch.setattr(folders, "_ROUND", 100, raising=False)  # several rounds
    contents = {f"/t/{k}" + "/in" * (k % 4) + f"/{n}": "pq"[(n + k) % 2] for k in range(99) for n in range(1 + k % 3)}
    lone = [f"/e/{k}" + "/none" * k for k in range(3)]
    rows = cut(with_ids(spark, contents))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {p for d in disk.localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    tables = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("twinsift-*/*"))
    before = shuffles(), tables()
    got = folders.duplicate_folders(rows, spark.createDataFrame([(d,) for d in lone], "path string"))
    read = {Path(p.removeprefix("file:")).parent for p in got.inputFiles()}
    until = time.monotonic() + 20  # executors are told to free them, and do so in their time
    large = lambda: [p for p in shuffles() - before[0] if p.exists() and p.stat().st_size > 200]
    while large() and time.monotonic() < until:
        time.sleep(0.1)
    assert not large() and {p for p in tables() - before[1] if any(p.glob("part-*"))} <= read
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert groups(got) == plain_folders(contents, lone)


def test_folder_plans_take_files_up_level_by_level(spark):
    """Only selected folders are spread over what lies above them: files and offered folders would all meet at the top."""
    fold = cut(spark.createDataFrame([("/t/a", f"/t/{c}", 2, True) for c in "abc"], "group_id string, path string, n_files long, is_current boolean"))
    now = cut(spark.createDataFrame([(f"/t/{c}/{k}/x", 1, f"d{k}{c if c == 'c' else ''}") for c in "abc" for k in (1, 2)], "path string, size long, digest string"))
    plan = cleanup.folder_plan(fold, now, cut(spark.createDataFrame([("/t/b",), ("/t/c",)], "path string")))
    assert sorted((r.path, r.verdict, r.reason) for r in plan.collect()) == [("/t/b", "remove", None), ("/t/c", "keep", "contents differ")]
    # the selection's folders, which are read for the references and for the rows
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2


def test_folders_are_told_apart_by_two_numbers(spark):
    """What moves for a folder's or an owner's contents is as wide for large ones as for small ones."""
    rows = spark.createDataFrame([(f"/t/{k}/{n}", 1, n) for k in range(2) for n in range(9)], "path string, size long, content_id long")
    kept = "struct<x:bigint,y:bigint>"
    assert folders.signed(folders.folder_sums(rows)).schema["signature"].dataType.simpleString() == kept
    owned = folders.multiset_signature(rows.select(F.substring("path", 1, 4).alias("o"), "content_id"), "o", "content_id")
    assert owned.schema["signature"].dataType.simpleString() == kept and owned.select("signature", "n_items").distinct().count() == 1


def test_images_are_read_once(spark):
    """What works signatures out runs once for each image: rows aren't read again to meet their nodes."""
    seen = spark.sparkContext.accumulator(0)

    def slow(x):
        seen.add(1)
        return x

    images = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(3).alias("width"), F.lit(2).alias("height"), F.udf(slow, "long")("id").alias("signature"))
    assert similar.image_groups(images, 1).count() > 0
    assert seen.value == 40


def test_word_votes_are_those_of_distinct_words():
    """Each distinct word votes once, whatever splits the texts: nulls, empty words and more words than a narrow lane counts."""
    import hashlib

    import pyarrow as pa

    texts = ["a b a", None, "", "  ", "ä  ö\nx a", " ".join(map(str, range(70_000))), "a b a"]
    got = fingerprints.votes(pa.array(texts)).tolist()
    for text, row in zip(texts, got, strict=True):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in set((text or "").split(" ")) if w]
        assert row == [len(hashes)] + [sum(h >> i & 1 for h in hashes) for i in range(60)]
    assert sum(len(x) for x in fingerprints._parts(pa.array(texts))) == len(texts)


def test_signatures_move_a_row_per_document(spark, sf_dir):
    """Words are hashed and counted where their text is read: none becomes a row."""
    plan = registry.signatures(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("word_votes") == 1


def test_words_are_hashed_by_md5():
    """The hashes of words of every length around one block, of a slice, and of none."""
    import hashlib

    import pyarrow as pa

    words = ["", "é" * 27, "é" * 28, *("x" * k for k in range(130))]
    want = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in words]
    assert fingerprints.word_hashes(pa.array(words)).tolist() == want
    assert fingerprints.word_hashes(pa.array(words).slice(5, 70)).tolist() == want[5:75]
    assert fingerprints.word_hashes(pa.array([], pa.string())).tolist() == []


def test_signatures_are_worked_out_in_one_pass(spark, sf_dir):
    """Neither do votes move, nor are texts hashed again for a filter on what comes of them."""
    plan = registry.signatures(spark, sf_dir).where("signature IS NOT NULL AND signature > 5")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_document_in_several_rows_has_one_signature(spark, tmp_path):
    """Its words count once over all of its rows; rows without an id are one document."""
    import hashlib

    rows = [(1, "a b c"), (1, "a b d  e"), (1, None), (2, "a b"), (None, "x y"), (None, "x z w"), (3, None), (4, " "), (5, " "), (5, "q")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d in {d for d, _ in rows}:
        words = {w for e, t in rows if e == d for w in (t or "").split(" ") if w}
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
        if words:
            want[d] = sum(1 << i for i in range(60) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    got = registry.signatures(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == set(want.items()) and len(got) == len(want)


def test_images_that_meet_none_are_no_nodes(spark, monkeypatch):
    """Only what is near another signature, or shares its own, is ordered and looked at for references."""
    seen, first_come = [], similar.first_come
    monkeypatch.setattr(similar, "first_come", lambda links, nodes, *more: seen.append(nodes.count()) or first_come(links, nodes, *more))
    far = [(f"far{k}", 3, 2, v) for k, v in enumerate((0xF << 40, 0xFF << 20, 0xFFF << 8))]
    near = [("b", 3, 2, 0), ("a", 3, 2, 1), ("c", 6, 4, 0xFFFF << 44), ("d", 3, 2, 0xFFFF << 44), ("e", 2, 3, 0xFFFF << 44), ("E", 2, 3, 0xFFFF << 44)]
    got = similar.image_groups(spark.createDataFrame(far + near, "path string, width int, height int, signature long"), 1).collect()
    assert sorted(tuple(r) for r in got) == [("E", "e", 0), ("a", "b", 1), ("c", "d", 0)]
    assert seen == [5]


def test_each_cell_of_blocks_is_a_task(spark):
    df = spark.createDataFrame([(v << 30,) for v in range(200)], "signature long")
    met = neighbours.meetings(df, df, neighbours.bands_of(1, 63, 3), 1, (3, 3))
    assert met.rdd.getNumPartitions() == 6
    assert sorted(tuple(r) for r in met.collect()) == sorted((a << 30, b << 30) for a in range(200) for b in range(200) if (a ^ b).bit_count() <= 1)


def test_rows_are_numbered_by_as_many_tasks_as_asked_for(spark):
    from twinsift.operators.graph import numbered

    rows = numbered(spark.createDataFrame([(k * 7 % 50,) for k in range(50)], "x long"), "x", first=3, tasks=2)
    assert sorted((r.x, r.row) for r in rows.collect()) == [(k, k + 3) for k in range(50)]
    assert numbered(spark.createDataFrame([], "x long"), "x", tasks=1).count() == 0
