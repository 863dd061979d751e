"""Inventories of real folders, snapshots, and groups that grow."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringEndsWith, StringStartsWith

from tests.test_operators import files, groups
from twinsift.operators import exact, folders, similar
from twinsift.plans import scan
from twinsift.plans.matching import matching
from twinsift.scratch import shared_folder
from twinsift.sources import session, snapshot
from twinsift.sources.inventory import InventoryReader, InventorySource, read_inventory, walk_inventory
from twinsift.streaming import grown, incremental
from twinsift.streaming.keyed import KeyedGroups


def test_inventory_lists_empty_hidden_and_linked_entries(spark, tmp_path):
    for name, data in {"one/a": b"x", "one/.hidden": b"", "two/b": b"x", "skip/c": b"x", "two/deep/d": b"yy"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "one", tmp_path / "link")
    found, dirs, issues = read_inventory(spark, [str(tmp_path)], excluded=(str(tmp_path / "skip"),), content=True)
    short = lambda df: {r.path.removeprefix(str(tmp_path)) for r in df.collect()}
    assert short(found) == {"/one/a", "/one/.hidden", "/two/b", "/two/deep/d", "/link"}
    assert short(dirs) == {"", "/one", "/two", "/two/deep"}
    assert issues.count() == 0
    assert groups(exact.duplicate_groups(found.where("is_regular"))) == [[f"{tmp_path}/one/a", f"{tmp_path}/two/b"]]
    flat, _, _ = read_inventory(spark, [str(tmp_path / "two")], recursive=False)
    assert short(flat) == {"/two/b"}
    _, _, gone = read_inventory(spark, [str(tmp_path / "missing")])
    assert gone.count() == 1


def tree(at, r, n):
    """Files and folders by chance below ``at``: paths of files with their bytes."""
    made = {}
    for _ in range(n):
        folder = at.joinpath(*(r.choice(["a", "b", "c"]) for _ in range(r.randrange(5))))
        folder.mkdir(parents=True, exist_ok=True)
        name = folder / f"f{r.randrange(9)}{r.choice(['.jpg', '.JPG', '.txt', ''])}"
        name.write_bytes(bytes(r.randrange(4)))
        made[str(name)] = name.read_bytes()
    return made


def test_walk_in_rounds_lists_what_the_source_lists(spark, tmp_path):
    made = tree(tmp_path, random.Random(2), 40)
    (tmp_path / "a/empty").mkdir(parents=True)
    os.symlink(tmp_path, tmp_path / "loop")
    roots = [str(tmp_path), str(tmp_path / "a"), str(tmp_path / "gone")]
    for asked in ({}, {"excluded": (str(tmp_path / "b"),), "content": True}, {"recursive": False}, {"suffixes": (".jpg",)}):
        one, other = read_inventory(spark, roots, **asked), walk_inventory(spark, roots, **asked)
        for a, b in zip(one, other, strict=True):
            rows = lambda df: sorted(map(repr, df.drop("streams").collect()))
            assert rows(a) == rows(b) and len(set(rows(b))) == len(rows(b))
    found = walk_inventory(spark, roots, suffixes=(".jpg",))[0]
    assert {r.path for r in found.collect()} == {p for p in made if p.lower().endswith(".jpg")}


def test_one_deep_root_is_many_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"only/one/{k}").mkdir(parents=True)
        (tmp_path / f"only/one/{k}/f").write_bytes(b"x")
    files_, dirs, _ = walk_inventory(spark, [str(tmp_path)])
    assert files_.count() == 40 and dirs.count() == 43
    held = walk_inventory(spark, [str(tmp_path)], content=True)[0].where("path LIKE '%/f'")
    assert len({r.at.rsplit("/", 1)[-1] for r in held.select(F.input_file_name().alias("at")).collect()}) >= 2


def test_filters_reach_the_source(spark, tmp_path):
    made = tree(tmp_path, random.Random(7), 40)
    reader = InventoryReader({"roots": str(tmp_path), "content": "true"})
    begins = str(tmp_path / "a")
    rest = list(reader.pushFilters([EqualTo(("kind",), "file"), StringStartsWith(("path",), begins), StringEndsWith(("path",), ".jpg"), EqualTo(("size",), 1)]))
    assert rest == [EqualTo(("size",), 1)] and (reader.kinds, reader.begins, reader.ends) == ({"file"}, (begins,), (".jpg",))
    assert [p.path for p in reader.partitions()] == [str(tmp_path), begins]
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert {row[0]: row[13] for row in rows} == {p: data for p, data in made.items() if p.startswith(begins) and p.endswith(".jpg")}
    for path in made:  # what isn't asked for isn't opened: a folder's rows come though no file can be read
        os.chmod(path, 0)
    spark.dataSource.register(InventorySource)
    found, dirs, _ = read_inventory(spark, [str(tmp_path)])
    some = found.where(F.col("path").startswith(begins) & F.col("path").endswith(".jpg") & (F.col("size") > 0))
    assert {r.path for r in some.collect()} == {p for p, data in made.items() if p.startswith(begins) and p.endswith(".jpg") and data}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.split("BatchScan")[0] and dirs.count() == sum(len(d) for _, d, _ in os.walk(tmp_path)) + 1


def test_scans_tell_progress_and_can_be_cancelled(spark, tmp_path):
    f = files(spark, **{"/a/x": b"1", "/b/x": b"1"})
    slow = F.udf(lambda p: time.sleep(4) or p)
    held, told = scan.Inventory(f.withColumn("path", slow("path"))), []
    ledger = scan.run(spark, scan.Inventory(f), scan.Request(("files", "folders")), f"file://{tmp_path}/whole", progress=told.append)
    assert {(r.kind, r.state) for r in ledger.collect()} == {("files", "done"), ("folders", "done")}
    assert {(p.kind, p.kinds_done, p.n_kinds) for p in told} == {("files", 0, 2), ("folders", 1, 2)} and all(0 <= p.tasks_done <= p.n_tasks for p in told)
    tables = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir()}
    before, begun = tables(), time.monotonic()
    ledger = scan.run(spark, held, scan.Request(("files", "folders")), f"file://{tmp_path}/cut", go_on=lambda: time.monotonic() - begun < 1.5)
    assert [(r.kind, r.state, r.reason) for r in ledger.collect()] == [("files", "cancelled", None), ("folders", "skipped", None)]
    assert not (tmp_path / "cut/files").exists() and tables() == before

    def broken(p):
        raise RuntimeError("no one listens")

    ledger = scan.run(spark, held, scan.Request(("files",)), f"file://{tmp_path}/deaf", progress=broken)
    assert [(r.state, r.reason) for r in ledger.collect()] == [("failed", "no one listens")]


def test_snapshots_round_trip_and_are_checked(spark, tmp_path):
    f = files(spark, **{"/a": b"x", "/b": b"x", "/c": b"yy", "/d": b"yy"})
    members = exact.duplicate_groups(f)
    snapshot.save(members, f"file://{tmp_path}/s")
    back = snapshot.load(spark, f"file://{tmp_path}/s")
    assert back.count() == 2
    assert {r.rule for r in snapshot.violations(back).collect()} == set()
    now = f.where("path <> '/d'")
    kept, issues = snapshot.restore(back, now)
    assert {r.path for r in kept.collect()} == {"/a", "/b"} and [r.path for r in issues.collect()] == ["/d"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"group_id": "g", "digest": "zz", "files": [{"path": "rel", "size": -1, "modified_ns": 1, "inode": 1}]}')
    rules = {r.rule for r in snapshot.violations(snapshot.load(spark, f"file://{tmp_path}/bad")).collect()}
    assert rules == {"path", "size", "digest", "members"}


OLD = {"/o/unique.txt": b"match", "/o/copy-a.bin": b"olddup", "/o/copy-b.bin": b"olddup", "/o/alone.txt": b"alone"}
NEW = {"/n/renamed.txt": b"match", "/n/third.bin": b"olddup", "/n/new-a": b"newdup", "/n/new-b": b"newdup"}


def test_growing_equals_scanning_anew(spark):
    whole = groups(incremental.full_groups(files(spark, **OLD, **NEW), matching()))
    assert groups(incremental.incremental_groups(files(spark, **OLD), files(spark, **NEW), matching())) == whole and len(whole) == 3
    with pytest.raises(ValueError):
        incremental.check_settings(matching(), matching("name"))
    state = incremental.retained(files(spark, **OLD), matching())
    lone = incremental.retained(files(spark, **OLD, **{"/o/lone": b"of its own size"}), matching())
    assert [r.path for r in lone.where("digest IS NULL").collect()] == ["/o/lone"]  # its content is never read
    late = files(spark, **{"/n/second": b"of its own size"})
    assert groups(incremental.members_of(incremental.extend(lone, late, matching(), files(spark, **{"/o/lone": b"of its own size"}))[1], matching())) == [["/n/second", "/o/lone"]]
    after, found = incremental.extend(state, files(spark, **NEW), matching(), files(spark, **OLD))
    assert after.count() == 8 and "/o/unique.txt" in {r.path for r in found.collect()}
    later, found = incremental.extend(after, files(spark, **{"/t/later.txt": b"alone"}), matching(), files(spark, **OLD))
    assert groups(incremental.members_of(found, matching())) [-2:] == [["/n/renamed.txt", "/o/unique.txt"], ["/o/alone.txt", "/t/later.txt"]] and later.count() == 9
    assert tuple(incremental.tally(files(spark, **NEW), incremental.tally(files(spark, **OLD))).first()) == (8, 45)
    with pytest.raises(ValueError):
        incremental.retained(files(spark, **OLD), matching("name~2"))
    left, issues = incremental.drop_stale(state, files(spark, **(OLD | {"/o/copy-a.bin": b"changed"})))
    assert left.count() == 3 and [r.path for r in issues.collect()] == ["/o/copy-a.bin"]


def test_media_and_folders_grow(spark):
    images = lambda *rows: spark.createDataFrame(list(rows), "path string, width int, height int, signature long")
    old, new = images(("m", 30, 20, 3), ("z", 30, 20, 0)), images(("a", 30, 20, 1))
    got = {tuple(r) for r in grown.extend_media(grown.scan_media("images", old, "Strict"), new).groups.collect()}
    assert got == {("a", "m", 1), ("a", "z", 1)}  # the new image is the reference now
    first = {"/a/x": b"1", "/a/y": b"22"}
    state = incremental.extend_folders(incremental.scan_folders(files(spark).selectExpr("path", "size", "cast(null as string) digest")), files(spark, **first))
    assert state.groups.count() == 0
    state = incremental.extend_folders(state, files(spark, **{"/b/p": b"22", "/b/q": b"1"}))
    assert groups(state.groups) == [["/a", "/b"]] and state.files.count() == 4


@pytest.mark.parametrize("seed", [3, 4])
def test_folder_state_equals_a_scan_anew(spark, seed):
    """Batches of files, replaced ones among them, directories of their own and unreadable entries; sums and groups are those of all at once."""
    r = random.Random(seed)
    some = lambda n: {"/" + "/".join(r.choice("ab") for _ in range(r.randrange(1, 4))) + f"/{r.choice('xyz')}": r.choice([b"1", b"22"]) for _ in range(n)}
    dirs = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    told = lambda *names: spark.createDataFrame([(n, "unreadable") for n in names], "path string, reason string")
    digested = lambda f: f.withColumn("digest", F.sha2("content", 256)).drop("content")
    steps = [(some(6), ("/e", "/a/e"), ()), (some(5), ("/e", "/f/g"), ()), ({}, ("/b/h",), ("/a/b/locked",)), (some(4), (), ())]
    state, every, names, issues = None, {}, [], []
    for added, folders_, bad in steps:
        every, names, issues = every | added, [*names, *folders_], [*issues, *bad]
        now = files(spark, **added)
        if state is None:
            state = incremental.scan_folders(digested(now), dirs(*folders_), told(*bad))
        else:
            state = incremental.extend_folders(state, now, dirs(*folders_), told(*bad))
        whole = digested(files(spark, **every)).withColumnRenamed("digest", "content_id")
        want = folders.folder_sums(whole, dirs(*names).distinct())
        assert sorted(map(tuple, state.sums.collect())) == sorted(map(tuple, want.select(*state.sums.columns).collect()))
        want = folders.duplicate_folders(whole, dirs(*names).distinct(), told(*issues))
        assert sorted(map(tuple, state.groups.collect())) == sorted(map(tuple, want.collect()))


def test_media_state_equals_grouping_anew(spark):
    """Batches of images around few signatures, with copies, moved nodes, repeated paths, and nothing at all."""
    r = random.Random(5)
    schema = "path string, width int, height int, signature long"
    centres = [r.getrandbits(63) for _ in range(4)]

    def batch(k, n):
        flips = lambda: sum(1 << b for b in r.sample(range(63), r.randrange(5)))
        return [(f"/{r.choice('zyxwvuAB')}{k}-{i}", *r.choice([(30, 20), (60, 40), (20, 30)]), r.choice([r.choice(centres) ^ flips(), centres[0], None])) for i in range(n)]

    batches = [batch(0, 30), batch(1, 12), [], batch(3, 3), batch(4, 25)]
    batches[4].append(batches[0][0])  # a path that is held already
    state, every = grown.scan_media("images", spark.createDataFrame(batches[0], schema), "Strict"), list(batches[0])
    for rows in batches[1:]:
        state = grown.extend_media(state, spark.createDataFrame(rows, schema))
        every = list({row[0]: row for row in [*rows, *every]}.values())
        want = similar.image_groups(spark.createDataFrame(every, schema), similar.IMAGE_RADII["Strict"])
        assert sorted(map(tuple, state.groups.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        grown.scan_media("images", spark.createDataFrame(batches[0], schema), "Lax")


def test_video_state_equals_grouping_anew(spark):
    r = random.Random(9)
    schema = "path string, width int, height int, duration double, signatures array<long>"
    base = [[r.getrandbits(63) for _ in range(24)] for _ in range(2)]

    def batch(k, n):
        near = lambda frames: [None if r.random() < 0.05 else f ^ (1 << r.randrange(63)) if r.random() < 0.5 else f ^ r.getrandbits(20) if r.random() < 0.1 else f for f in frames]
        return [(f"/{r.choice('zyxab')}{k}-{i}", *r.choice([(32, 18), (64, 36)]), r.choice([99.9, 100.0, 101.2]), near(r.choice(base)) if r.random() < 0.8 else base[0]) for i in range(n)]

    batches = [batch(0, 14), batch(1, 8), batch(2, 2)]
    state, every = grown.scan_media("videos", spark.createDataFrame(batches[0], schema), "Balanced"), list(batches[0])
    for rows in batches[1:]:
        state, every = grown.extend_media(state, spark.createDataFrame(rows, schema)), every + rows
        want = similar.video_groups(spark.createDataFrame(every, schema), "Balanced")
        assert sorted(map(tuple, state.groups.collect())) == sorted(map(tuple, want.collect())) and state.groups.count()


@pytest.mark.parametrize("seed", range(3))
def test_repaired_references_are_first_come(spark, seed):
    """Only nodes that a change can reach are chosen anew, and the outcome is that of going through all in order."""
    r = random.Random(seed)
    places = r.sample(range(100), 40)
    pairs = {(min(a, b), max(a, b)) for a, b in (r.sample(places, 2) for _ in range(70))}
    new = set(r.sample(places, 4))

    def greedy(nodes):
        chosen = []
        for v in sorted(nodes):
            if not any((u, v) in pairs for u in chosen):
                chosen.append(v)
        return set(chosen)

    column = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    refs, redone = grown.repair(spark.createDataFrame(sorted(pairs), "earlier int, later int"), column("node", greedy(set(places) - new)), column("node", new))
    assert sorted(x.node for x in refs.collect()) == sorted(greedy(places))
    redone = {x.node for x in redone.collect()}
    assert new | (greedy(places) ^ greedy(set(places) - new)) <= redone < set(places)


def test_groups_go_with_their_reference(spark):
    rec = lambda p: (p, 1, 1, 1)
    schema = "group_id string, digest string, byte_verified boolean, ref string, files array<struct<path:string,size:bigint,modified_ns:bigint,inode:bigint>>"
    saved = spark.createDataFrame([("g", None, None, "/a", [rec("/a"), rec("/b"), rec("/c")]), ("h", None, None, "/d", [rec("/d"), rec("/e"), rec("/f")])], schema)
    now = spark.createDataFrame([rec(p) for p in ("/b", "/c", "/d", "/e")], "path string, size long, modified_ns long, inode long")
    kept = lambda **k: {r.path for r in snapshot.restore(saved, now, **k)[0].collect()}
    assert kept() == {"/b", "/c", "/d", "/e"} and kept(reference="ref") == {"/d", "/e"}


def test_sessions_are_saved_whole(spark, tmp_path):
    place = f"file://{tmp_path}/review"
    with pytest.raises(ValueError):
        session.load(spark, place)
    members = exact.duplicate_groups(files(spark, **{"/r/a": b"x", "/r/b": b"x"}))
    trees = spark.createDataFrame([("/r/t", "/r/t", 2, 5), ("/r/t", "/r/u", 2, 5), ("/r/e", "/r/e", 0, 0)], "group_id string, path string, n_files long, total_size long")
    near = spark.createDataFrame([("/r/1", "/r/2", 3), ("/r/3", "/r/4", 0)], "reference string, path string, distance int")
    (tmp_path / "review/other").mkdir(parents=True)
    session.save(spark, session.Session(("/r",), ("/r/tmp",), True, 4, 12, {"groups": members}), place)
    session.save(spark, session.Session(("/r",), ("/r/tmp",), False, 9, 30, {"groups": members, "folders": trees, "matches": near}), place)
    back = session.load(spark, place)
    assert (back.roots, back.excluded, back.recursive, back.n_files, back.n_bytes) == (("/r",), ("/r/tmp",), False, 9, 30)
    assert sorted(back.results) == ["folders", "groups", "matches"]
    assert sorted(p.name[:8] for p in (tmp_path / "review").iterdir() if p.is_dir()) == ["other", "session-"]
    assert {r.path for r in back.results["groups"].selectExpr("explode(files.path) path").collect()} == {"/r/a", "/r/b"}
    kept = lambda now: {r.path for r in session.restored_folders(back.results["folders"], now).collect()}
    assert kept(trees) == {"/r/t", "/r/u", "/r/e"} and kept(trees.where("path <> '/r/u'")) == {"/r/e"}
    assert kept(trees.withColumn("total_size", F.lit(6).cast("long"))) == set()
    there = spark.createDataFrame([("/r/1",), ("/r/2",), ("/r/4",)], "path string")
    assert [tuple(r) for r in session.restored_matches(back.results["matches"], there).collect()] == [("/r/1", "/r/2", 3)]
    for bad in (session.Session(("r",)), session.Session(("/r",), ("/q",)), session.Session(("/r",), n_files=-1), session.Session(("/r",), results={"other": near})):
        with pytest.raises(ValueError):
            session.save(spark, bad, place)
    (tmp_path / "review/.about.json.crc").unlink(missing_ok=True)
    (tmp_path / "review/about.json").write_text('{"version": 7}')
    with pytest.raises(ValueError):
        session.load(spark, place)


def test_sessions_keep_criteria_selection_and_evidence(spark, tmp_path):
    place, want = f"file://{tmp_path}/s", matching("name~2 unmarked", "size", evidence="digest", several_folders=True)
    frames = [("/v/a", 320, 180, 100.0, [k * 999 for k in range(24)]), ("/v/b", 320, 180, 100.0, [k * 999 ^ 1 for k in range(24)]), ("/v/c", 320, 180, 101.0, [k * 999 ^ (0xFFFFFFFFFFFF if 8 <= k < 14 else 0) for k in range(24)])]
    videos = spark.createDataFrame(frames, session.SECTIONS["frames"])
    matches = similar.video_groups(videos, "Broad")
    assert {r.path for r in matches.collect()} == {"/v/b"}
    true = tuple(matches.first())
    claims = [true, ("/v/a", "/v/b", 12, 12, true[4] + 1), ("/v/a", "/v/c", 9, 12, 48), ("/v/a", "/v/a", 12, 12, 0), ("/v/a", "/v/gone", 12, 12, 0)]
    # nine slots of twelve are equal, but not two of the middle third: the preset refuses what the record rightly counts
    e = spark.createDataFrame([(frames[0][4], frames[2][4])], "a array<long>, b array<long>").select(similar.slot_evidence(F.col("a"), F.col("b"), 12).alias("e")).first().e
    claims[2] = ("/v/a", "/v/c", e.matched, e.valid, e.total)
    assert e.matched == 9 and e.thirds == 1
    chosen = spark.createDataFrame([("/v/b",)], "path string")
    pictures = spark.createDataFrame([("/i/a", 3, 2, 7)], session.SECTIONS["fingerprints"])
    held = session.Session(("/v",), results={"videos": spark.createDataFrame(claims, session.SECTIONS["videos"]), "frames": videos, "selection": chosen, "fingerprints": pictures}, want=want, images="Strict", videos="Broad")
    session.save(spark, held, place)
    back = session.load(spark, place)
    assert str(back.want) == str(want) and back.want == want and (back.images, back.videos) == ("Strict", "Broad")
    assert [tuple(r) for r in back.results["videos"].collect()] == [true]
    assert [r.path for r in back.results["selection"].collect()] == ["/v/b"] and tuple(back.results["fingerprints"].first()) == ("/i/a", 3, 2, 7)
    with pytest.raises(ValueError):
        session.save(spark, session.Session(("/v",), videos="Loose"), place)
    about = (tmp_path / "s/about.json").read_text()
    (tmp_path / "s/.about.json.crc").unlink(missing_ok=True)
    (tmp_path / "s/about.json").write_text(about.replace("name~2", "smell"))
    with pytest.raises(ValueError):
        session.load(spark, place)


def test_every_rule_of_a_record_is_told(spark):
    good = ("/a", 1, 2, 3, [(":s:$DATA", 4)], [(":s:$DATA", "0" * 64)])
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("path", "size", "modified", "inode", "streams", "hashes"), good, strict=True))
    broken = {
        "path": change(path="a"), "size": change(size=-1), "modified_ns": change(modified=None), "inode": change(inode=None), "stream name": change(streams=[("s", 4)]),
        "stream size": change(streams=[(":s:$DATA", -4)]), "stream twice": change(streams=[(":s:$DATA", 4)] * 2), "stream digest": change(hashes=[(":s:$DATA", "zz")]),
    }
    record = "path:string,size:bigint,modified_ns:bigint,inode:bigint,streams:array<struct<name:string,size:bigint>>,stream_hashes:array<struct<name:string,sha256:string>>"
    rows = [(rule, None, [bad, (f"/{k}", *good[1:])]) for k, (rule, bad) in enumerate(broken.items())]
    rows = [(g, d, [(f"{x[0]}{k}" if j == 0 and g != "path" else x[0], *x[1:]) for j, x in enumerate(f)]) for k, (g, d, f) in enumerate(rows)]
    rows += [("digest", "zz", [("/p", *good[1:]), ("/q", *good[1:])]), ("members", None, [("/r", *good[1:])]), ("path twice", None, [("/t", *good[1:]), ("/t", *good[1:])])]
    got = {(r.group_id, r.rule) for r in snapshot.violations(spark.createDataFrame(rows, f"group_id string, digest string, files array<struct<{record}>>")).collect()}
    assert got == {(g, g) for g, _, _ in rows}


def test_stream_of_additions(spark, tmp_path):
    source, held = f"file://{tmp_path}/in", f"file://{tmp_path}/held"
    files(spark, **OLD).coalesce(1).write.parquet(source)
    grown = incremental.GroupStream(spark, held)
    stream = lambda: spark.readStream.schema(files(spark, **OLD).schema).parquet(source)
    grown.start(stream(), f"file://{tmp_path}/ck").awaitTermination()
    assert groups(grown.groups()) == [["/o/copy-a.bin", "/o/copy-b.bin"]]
    files(spark, **NEW).coalesce(1).write.mode("append").parquet(source)
    grown.start(stream(), f"file://{tmp_path}/ck").awaitTermination()
    assert groups(grown.groups()) == groups(incremental.full_groups(files(spark, **OLD, **NEW), matching()))
    before = grown.state().count()
    grown.add(files(spark, **NEW), 0)
    assert grown.state().count() == before
    with pytest.raises(ValueError):
        incremental.GroupStream(spark, held, matching("name"))


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_stream_of_additions_and_removals(spark, tmp_path, seed):
    """After every batch the groups are those of a scan of what is there; only what a batch touches is told."""
    r = random.Random(seed)
    source, held = f"file://{tmp_path}/in", f"file://{tmp_path}/held"
    schema = "path string, size long, content binary, removed boolean, seq long"
    keyed, now, seq = KeyedGroups(spark, held), {}, 0
    for _ in range(4):
        rows = []
        for _ in range(25):
            path, seq = f"/p{r.randrange(30)}", seq + 1
            if path in now and r.random() < 0.4:
                now.pop(path)
                rows.append((path, None, None, True, seq))
            else:
                now[path] = bytes([65 + r.randrange(6)]) * (1 + r.randrange(2))
                rows.append((path, len(now[path]), bytearray(now[path]), None, seq))
        late = (rows[0][0], 1, bytearray(b"late"), None, -1)  # older than what is known of its path
        r.shuffle(rows)
        spark.createDataFrame([*rows, late], schema).coalesce(1).write.mode("append").parquet(source)
        keyed.start(spark.readStream.schema(schema).parquet(source), f"file://{tmp_path}/ck").awaitTermination()
        assert groups(keyed.groups()) == groups(incremental.full_groups(files(spark, **now), matching()))
    before = spark.read.parquet(held).count()
    spark.createDataFrame([("/lone", 9, bytearray(b"alone now"), None, seq + 1), ("/never", None, None, True, seq + 1)], schema).coalesce(1).write.mode("append").parquet(source)
    keyed.start(spark.readStream.schema(schema).parquet(source), f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(held).count() == before
    with pytest.raises(ValueError):
        KeyedGroups(spark, held, matching("size~2", evidence=""))


def test_keyed_stream_keeps_sizes(spark, tmp_path):
    source, held = f"file://{tmp_path}/in", f"file://{tmp_path}/held"
    schema = "path string, size long, removed boolean, seq long"
    keyed = KeyedGroups(spark, held, matching("name", evidence=""))
    for rows in ([("/a/x", 1, False, 1), ("/b/X", 2, False, 2)], [("/a/x", 5, False, 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        keyed.start(spark.readStream.schema(schema).parquet(source), f"file://{tmp_path}/ck").awaitTermination()
    assert {(r.path, r.size) for r in keyed.groups().collect()} == {("/a/x", 5), ("/b/X", 2)}


def test_a_delta_of_media_is_joined_once(spark, monkeypatch):
    """A scan joins its nodes with themselves, a delta its new nodes with all; the links of old nodes with new ones are those turned round."""
    joins = []
    links = similar.hamming_pairs
    monkeypatch.setattr(similar, "hamming_pairs", lambda a, b, radius: joins.append((a is b, a.count(), b.count())) or links(a, b, radius))
    images = lambda *rows: spark.createDataFrame(list(rows), "path string, width int, height int, signature long")
    old, new = [("b", 30, 20, 0), ("c", 30, 20, 7), ("d", 30, 20, 1 << 40)], [("a", 60, 40, 1), ("e", 30, 20, 3)]
    state = grown.extend_media(grown.scan_media("images", images(*old), "Strict"), images(*new))
    assert joins == [(True, 3, 3), (False, 2, 5)]
    near = {(x[0], y[0]) for x in old + new for y in old + new if (x[3] ^ y[3]).bit_count() <= 4}
    assert sorted((r.a, r.b) for r in state.links.select("a.path", "b.path").toDF("a", "b").collect()) == sorted(near)
    assert {tuple(r) for r in state.groups.collect()} == {tuple(r) for r in similar.image_groups(images(*old, *new), 4).collect()}


def test_restored_matches_are_worked_out_once(spark):
    """What is there is neither moved to be made distinct, nor are matches asked for again by each check."""
    seen = spark.sparkContext.accumulator(0)

    def slow(x):
        seen.add(1)
        return x

    matches = spark.range(20).select(F.lit("r").alias("reference"), F.format_string("p%d", "id").alias("path"), F.udf(slow, "long")("id").cast("int").alias("distance"))
    there = spark.createDataFrame([(p,) for p in ("r", "r", "p3", "p3", "p7", "other")], "path string")
    got = session.restored_matches(matches, there)
    assert sorted(tuple(r) for r in got.collect()) == [("r", "p3", 3), ("r", "p7", 7)] and seen.value == 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == plan.count("Generate") > 0  # only names in matches are made distinct
