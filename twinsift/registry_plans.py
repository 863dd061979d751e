"""Registered queries of scopes, reviews, plans, snapshots and grown results; ``registry`` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.functions import fingerprints, paths
from twinsift.operators import cleanup, exact, folders, review, scope, similar, tolerance
from twinsift.operators.graph import cut, numbered
from twinsift.plans.matching import matching
from twinsift.registry import _FILES, _GROUPS, _SELECTED, ORACLE_SQL, QUERIES, files, images, members, query, selection, table, videos
from twinsift.sources import session, snapshot
from twinsift.streaming import grown, incremental

_TOXIC = "toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"
_LABELLED = "bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)"
_FOLDER = "regexp_replace(path, '/[^/]*$', '')"


def labelled(spark, sf_dir, column: str, value: int):
    return table(spark, sf_dir, "labels").where(F.col(column) == value).select("doc_id").distinct()


def flagged(df, ids, name: str):
    """``df`` with a flag on rows whose doc_id is among ``ids``."""
    return df.join(ids.withColumn(name, F.lit(True)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


# scope


@query(f"WITH {_FILES} SELECT path FROM files WHERE {_FOLDER} IN ('/src1/en', '/src2/de')")
def direct_files(spark, sf_dir):
    return scope.direct_children(files(spark, sf_dir).select("path"), ["/src1/en", "/src2/de/"])


_TYPED = "typed AS (SELECT '/p/' || p_partkey || ['.JPG', '.mp4', '.pdf', '.7z', '.flac', '.xyz', '', '.webp'][1 + p_partkey % 8] AS path, ['Images', 'Videos', 'Documents', 'Archives', 'Audio', 'Other', 'Other', 'Images'][1 + p_partkey % 8] AS kind FROM part)"


def typed(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, (".JPG", ".mp4", ".pdf", ".7z", ".flac", ".xyz", "", ".webp"))), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"), ending).alias("path"))


@query(f"WITH {_TYPED} SELECT path, kind FROM typed")
def file_types(spark, sf_dir):
    return typed(spark, sf_dir).withColumn("kind", paths.file_type(F.col("path")))


@query(f"WITH {_TYPED} SELECT path FROM typed WHERE kind IN ('Images', 'Audio', 'Other')")
def files_of_types(spark, sf_dir):
    return scope.of_types(typed(spark, sf_dir), ["Images", "Audio", "Other"])


@query(f"WITH {_TYPED} SELECT path FROM typed WHERE kind = 'Images'")
def image_files(spark, sf_dir):
    return similar.of_media(typed(spark, sf_dir), "Images")


@query(f"WITH {_TYPED} SELECT count(*) FILTER (kind = 'Images') AS n_images, count(*) FILTER (kind = 'Videos') AS n_videos, count(*) FILTER (kind NOT IN ('Images', 'Videos')) AS n_ignored, count(*) FILTER (path LIKE '%.webp') AS n_compared FROM typed")
def media_totals(spark, sf_dir):
    t = typed(spark, sf_dir)
    return similar.media_counts(t, t.where(F.endswith("path", F.lit(".webp"))))


@query(
    "WITH p AS (SELECT '/' || p_brand || '/' || p_partkey AS path, p_partkey AS k, (p_partkey * 1031) % 8388608 AS a, CASE p_partkey % 3 WHEN 0 THEN 2684354572 WHEN 1 THEN 2415923226 ELSE 7 END::BIGINT AS t FROM part) "
    "SELECT path, CASE WHEN (a & 1024) <> 0 AND (t & 536870912) <> 0 THEN 'link' WHEN (a & 1024) <> 0 AND (t & 4294905855) <> 2415919130 THEN 'unsupported reparse point' WHEN (a & 4460544) <> 0 THEN 'not available locally' WHEN k % 11 = 0 THEN 'not a regular file' WHEN k % 5 = 0 THEN 'hard link' WHEN k % 13 = 0 THEN 'no identity' END AS reason FROM p"
)
def readable_files(spark, sf_dir):
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, F.lit(0xA000000C)).when(k % 3 == 1, F.lit(0x9000101A)).otherwise(F.lit(7)).cast("long")
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), k.cast("string"))
    rows = table(spark, sf_dir, "part").select(path.alias("path"), ((k * 1031) % 8388608).alias("attributes"), tag.alias("reparse_tag"), F.when(k % 5 == 0, 2).otherwise(1).alias("nlink"), (k % 11 != 0).alias("is_regular"), F.when(k % 13 != 0, k).alias("inode"))
    fine, issues = scope.readable(rows)
    return fine.select("path", F.lit(None).cast("string").alias("reason")).unionByName(issues)


@query("WITH o AS (SELECT '/' || o_orderkey AS path, o_orderstatus AS device, o_custkey AS inode FROM orders) SELECT min(path) AS path, device, inode FROM o GROUP BY device, inode")
def one_path_per_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("device"), F.col("o_custkey").alias("inode"))
    return scope.one_path_per_identity(rows)


@query(f"WITH {_FILES}, {_TOXIC}, {_LABELLED} SELECT path, doc_id NOT IN (SELECT doc_id FROM toxic) AND doc_id NOT IN (SELECT doc_id FROM bad) AS is_current FROM files")
def current_files(spark, sf_dir):
    """Files of toxic documents are gone, and those of bad ones have grown."""
    then = files(spark, sf_dir).select("doc_id", "path", "size")
    now = flagged(then.join(labelled(spark, sf_dir, "toxic", 1), "doc_id", "left_anti"), labelled(spark, sf_dir, "quality", 0), "bad")
    now = now.select("path", (F.col("size") + F.col("bad").cast("int")).alias("size"))
    return cleanup.current(then.select("path", "size"), now).select("path", "is_current")


@query(f"WITH {_FILES} SELECT path, min(path) OVER (PARTITION BY text) AS content_id FROM files")
def content_classes(spark, sf_dir):
    digests = files(spark, sf_dir).select("path", F.sha2("content", 256).alias("digest"))
    return folders.content_ids(digests, "digest").select("path", "content_id")


@query("SELECT conv_id, ':' || role || turn || ':$DATA' AS name, sha256(text) AS sha256 FROM conversations")
def digests_of_streams(spark, sf_dir):
    name = F.concat(F.lit(":"), "role", F.col("turn").cast("string"), F.lit(":$DATA"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(name.alias("name"), F.col("text").cast("binary").alias("content"))).alias("streams"))
    return held.select("conv_id", F.explode(fingerprints.stream_digests(F.col("streams"))).alias("s")).select("conv_id", "s.*")


# groups


@query(f"WITH {_GROUPS} SELECT DISTINCT group_id, 'Hash match — bytes not verified' AS status, TRUE AS has_digest FROM members")
def hash_groups(spark, sf_dir):
    groups = exact.summarize(exact.duplicate_groups(files(spark, sf_dir), matching("size", evidence="digest")))
    return groups.select("group_id", "status", F.col("digest").isNotNull().alias("has_digest"))


@query(f"WITH {_FILES} SELECT min(path) AS group_id, 'Possible match — contents not verified' AS status, FALSE AS contents_verified FROM files GROUP BY size HAVING count(*) > 1")
def unverified_groups(spark, sf_dir):
    groups = exact.summarize(exact.duplicate_groups(files(spark, sf_dir), matching("size", evidence="")))
    return groups.select("group_id", "status", "contents_verified")


_KIB = "CASE WHEN {0} < 1024 THEN format('{{:,}}', {0}) || ' B' WHEN {0} < 1048576 THEN format('{{:,.2f}}', {0} / 1024.0::DOUBLE) || ' KiB' ELSE format('{{:,.2f}}', {0} / 1048576.0::DOUBLE) || ' MiB' END"


@query(
    f"WITH RECURSIVE {_FILES}, f AS (SELECT path, size AS s, {_FOLDER} AS d FROM files), k AS (SELECT DISTINCT d, s FROM f), nxt AS (SELECT a.d, a.s, min(b.s) AS t FROM k a LEFT JOIN k b ON a.d = b.d AND b.s > a.s + 40 GROUP BY ALL), anchors AS (SELECT d, min(s) AS anchor FROM k GROUP BY d UNION ALL SELECT a.d, n.t FROM anchors a JOIN nxt n ON n.d = a.d AND n.s = a.anchor WHERE n.t IS NOT NULL), "
    f"m AS (SELECT f.path, f.s, f.d, max(a.anchor) AS anchor FROM f JOIN anchors a ON a.d = f.d AND a.anchor <= f.s GROUP BY ALL), g AS (SELECT min(path) AS group_id, count(*) AS n_files, min(s) AS low, max(s) AS high FROM m GROUP BY d, anchor HAVING count(*) > 1) SELECT group_id, n_files, CASE WHEN low = high THEN {_KIB.format('low')} ELSE {_KIB.format('low')} || ' – ' || {_KIB.format('high')} END AS sizes FROM g"
)
def loose_size_groups(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("root", F.lit("/"))
    groups = exact.summarize(exact.duplicate_groups(rows, matching("size~40", "folder whole cased", evidence="")))
    return groups.select("group_id", "n_files", review.size_range(F.col("least_size"), F.col("most_size")).alias("sizes"))


@query(f"WITH {_GROUPS} SELECT group_id, path, row_number() OVER (ORDER BY group_id, lower(path), path) AS place FROM members")
def ordered_members(spark, sf_dir):
    m = members(spark, sf_dir).select("group_id", "path")
    return numbered(m, *exact.member_order()).withColumnRenamed("row", "place")


@query(f"WITH {_GROUPS}, g AS (SELECT group_id, count(*) AS n_files, (sum(size) - max(size))::BIGINT AS e FROM members GROUP BY group_id), n AS (SELECT *, row_number() OVER (ORDER BY e DESC, group_id) AS group_no FROM g) SELECT group_id, group_no, row_number() OVER (ORDER BY n_files DESC, group_no) AS place FROM n")
def sorted_groups(spark, sf_dir):
    groups = review.numbered_groups(exact.summarize(members(spark, sf_dir)))
    return review.sorted_groups(groups, "n_files", descending=True).select("group_id", "group_no", "place")


@query(
    "WITH m AS (SELECT l_orderkey, list_sort(list(l_quantity::BIGINT)) AS q, list(DISTINCT l_returnflag) AS s, sum(l_linenumber)::BIGINT AS total_size, count(*) AS n_files FROM lineitem GROUP BY l_orderkey), p AS (SELECT q, n_files, total_size, unnest(['/t/' || l_orderkey, '/t/' || l_orderkey || '/in', '/t/' || l_orderkey || '/in/deep']) AS path, unnest([0, 1, 2]) AS level FROM m), "
    "g AS (SELECT *, min(path) OVER (PARTITION BY q, level) AS group_id, count(*) OVER (PARTITION BY q, level) AS n FROM p) SELECT group_id, path, n_files, total_size FROM g WHERE n > 1"
)
def nested_folders(spark, sf_dir):
    """Each folder holds another that holds all of its files, so equal folders lie within each other."""
    path = F.concat(F.lit("/t/"), F.col("l_orderkey").cast("string"), F.lit("/in/deep/"), F.col("l_linenumber").cast("string"))
    return folders.duplicate_folders(table(spark, sf_dir, "lineitem").select(path.alias("path"), F.col("l_linenumber").cast("long").alias("size"), F.col("l_quantity").cast("long").alias("content_id")))


@query(f"SELECT group_id, path, row_number() OVER (ORDER BY lower(group_id), group_id, lower(path), path) AS place FROM ({ORACLE_SQL['duplicate_folders']})")
def ordered_folders(spark, sf_dir):
    found = QUERIES["duplicate_folders"](spark, sf_dir).select("group_id", "path")
    return numbered(found, *folders.folder_order()).withColumnRenamed("row", "place")


# media

#: Matches that one task puts in order.
ORDERED = 1 << 14


@query(f"SELECT reference, path, distance, row_number() OVER (ORDER BY lower(reference), reference, distance, lower(path), path) AS place FROM ({ORACLE_SQL['image_groups']})")
def ordered_matches(spark, sf_dir):
    found = cut(similar.image_groups(images(spark, sf_dir), 4))
    tasks = -(-found.count() // ORDERED) or 1
    return numbered(found, *similar.match_order("reference", "path"), tasks=tasks).withColumnRenamed("row", "place")


@query(f"SELECT a, b, distance, row_number() OVER (ORDER BY a, distance, b) AS place FROM ({ORACLE_SQL['hamming_pairs']})")
def ordered_neighbours(spark, sf_dir):
    found = QUERIES["hamming_pairs"](spark, sf_dir)
    return numbered(found, "a", "distance", "b").withColumnRenamed("row", "place")


@query(
    "WITH t AS (SELECT doc_id, k, n_chars / 10.0::DOUBLE AS d, greatest(0::DOUBLE, n_chars / 10.0::DOUBLE * (0.05::DOUBLE + 0.9::DOUBLE * (k // 2) / 11) - 0.125::DOUBLE) AS first FROM documents, range(24) t(k) WHERE n_chars > 0) "
    "SELECT doc_id, k, floor(1000 * CASE WHEN k % 2 = 1 THEN least(d, first + 0.25::DOUBLE) ELSE first END + 0.5::DOUBLE)::BIGINT AS ms FROM t"
)
def frame_times(spark, sf_dir):
    """Milliseconds of each frame; the later one of a pair is a quarter of a second after the first, if the end allows."""
    times = similar.frame_times(F.col("n_chars") / 10.0)
    return table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.posexplode(times).alias("k", "t")).select("doc_id", F.col("k").cast("long").alias("k"), F.floor(F.col("t") * 1000 + 0.5).cast("long").alias("ms"))


@query("SELECT doc_id, n_chars::DOUBLE * 7 * n_chars * 5 <= 100000000 AND n_chars > 0 AND n_chars * 60 <= 604800 AS acceptable, len(list_filter(range(12), lambda s: (doc_id * 31 + 2 * s) % 3 <> 0 AND (doc_id + s) % 4 <> 0 OR (doc_id * 31 + 2 * s + 1) % 3 <> 0 AND (doc_id + s) % 4 <> 0)) >= 9 AS informative FROM documents")
def comparable_videos(spark, sf_dir):
    n, i = F.col("n_chars"), F.col("doc_id")
    sig = lambda k: F.when(((i * 31 + k) % 3 != 0) & ((i + F.floor(k / 2)) % 4 != 0), F.lit(1).cast("long"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (n * 7).alias("w"), (n * 5).alias("h"), (n * 60).cast("double").alias("d"), F.transform(F.sequence(F.lit(0), F.lit(23)), sig).alias("s"))
    return rows.select("doc_id", similar.acceptable_video(F.col("w"), F.col("h"), F.col("d")).alias("acceptable"), similar.informative(F.col("s")).alias("informative"))


# reviews


@query(f"WITH {_GROUPS}, {_SELECTED} SELECT path FROM chosen UNION SELECT path FROM members WHERE group_id IN (SELECT group_id FROM members WHERE size >= 4096)")
def select_all(spark, sf_dir):
    m = members(spark, sf_dir)
    shown = review.visible_groups(m, F.col("size") >= 4096)
    return review.select_all(shown, selection(spark, sf_dir))


@query(
    f"WITH {_GROUPS}, {_SELECTED}, m AS (SELECT group_id, path, path IN (SELECT path FROM chosen) AS sel, path LIKE '/src1/%' AS inside FROM members), s AS (SELECT group_id, count(*) FILTER (NOT sel AND NOT inside) AS kept, arg_min(path, (sel, path)) FILTER (inside) AS spare FROM m GROUP BY group_id) "
    "SELECT path FROM (SELECT path FROM chosen UNION SELECT path FROM m JOIN s USING (group_id) WHERE inside AND (kept > 0 OR path <> spare)) WHERE path NOT IN (SELECT path FROM m JOIN s USING (group_id) WHERE inside AND kept = 0 AND path = spare)"
)
def select_in_folder(spark, sf_dir):
    return review.select_in_folder(members(spark, sf_dir), selection(spark, sf_dir), "/src1")


@query(f"WITH {_GROUPS}, {_SELECTED} SELECT path FROM chosen WHERE path IN (SELECT path FROM members)")
def surviving_selection(spark, sf_dir):
    return review.surviving_selection(selection(spark, sf_dir), members(spark, sf_dir))


@query(f"WITH {_GROUPS}, {_SELECTED} SELECT DISTINCT path FROM chosen WHERE path IN (SELECT path FROM members WHERE size >= 1024)")
def cleared_selection(spark, sf_dir):
    """Files below a size are shown and cleared; what a filter hides stays selected."""
    m = members(spark, sf_dir)
    chosen = review.surviving_selection(selection(spark, sf_dir), m)
    return review.cleared(chosen, m.where("size < 1024"))


# plans


@query(f"WITH {_GROUPS}, {_SELECTED}, {_TOXIC} SELECT path, CASE WHEN doc_id IN (SELECT doc_id FROM toxic) THEN 'keep' ELSE 'remove' END AS verdict, CASE WHEN doc_id IN (SELECT doc_id FROM toxic) THEN 'changed since the scan' END AS reason FROM members WHERE path IN (SELECT path FROM chosen)")
def reviewed_plan(spark, sf_dir):
    m = flagged(members(spark, sf_dir), labelled(spark, sf_dir, "toxic", 1), "toxic").withColumn("is_current", ~F.col("toxic"))
    return cleanup.reviewed_plan(m, selection(spark, sf_dir))


@query("SELECT '/c/' || c_custkey AS path, CASE WHEN r IS NULL THEN 'remove' ELSE 'keep' END AS verdict, r AS reason FROM (SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'no longer there' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'no longer empty' END AS r FROM customer WHERE c_acctbal < 5000)")
def empty_folder_plan(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("path")
    inside = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat_ws("/", F.lit("/c"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("path"))
    now = customer.where("c_nationkey <> 5").select(path).unionByName(inside)
    return cleanup.empty_folder_plan(customer.select(path), now, customer.where("c_acctbal < 5000").select(path))


@query(
    "WITH m AS (SELECT '/o/' || l_orderkey AS path, l_orderkey AS k, list_sort(list(l_quantity::BIGINT)) AS q, list_sort(list({'s': l_linenumber, 'd': l_quantity::BIGINT + CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END})) AS now FROM lineitem GROUP BY l_orderkey), g AS (SELECT *, min(path) OVER (PARTITION BY q) AS group_id, count(*) OVER (PARTITION BY q) AS n FROM m), "
    "p AS (SELECT a.path, CASE WHEN b.k % 5 = 0 THEN 'comparison folder can''t be verified' WHEN a.k % 5 = 0 THEN 'changed since the scan' WHEN a.now <> b.now THEN 'contents differ' END AS reason FROM g a JOIN g b ON b.path = a.group_id WHERE a.n > 1 AND a.path <> a.group_id) SELECT path, 'copy' AS role, CASE WHEN reason IS NULL THEN 'remove' ELSE 'keep' END AS verdict, reason FROM p"
)
def folder_plan(spark, sf_dir):
    """All but the first of each group of equal folders are selected; some have changed, and some contents too."""
    path = F.concat_ws("/", F.lit("/o"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path")
    rows, quantity = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    groups = cut(folders.duplicate_folders(rows.select(path, F.col("l_linenumber").cast("long").alias("size"), quantity.alias("content_id"))))
    current = F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 5 != 0
    now = rows.select(path, F.col("l_linenumber").cast("long").alias("size"), (quantity + F.when(F.col("l_returnflag") == "R", 100).otherwise(0)).cast("string").alias("digest"))
    return cleanup.folder_plan(groups.withColumn("is_current", current), now, groups.where("path <> group_id").select("path"))


# snapshots


def saved(spark, sf_dir):
    """Groups as a snapshot holds them."""
    m = members(spark, sf_dir).withColumn("modified_ns", F.col("doc_id") * 1000).withColumn("inode", F.col("doc_id"))
    return m, m.groupBy("group_id", "digest", "byte_verified").agg(F.array_sort(F.collect_list(F.struct("path", "size", "modified_ns", "inode"))).alias("files"))


@query(f"WITH {_GROUPS}, {_TOXIC}, {_LABELLED} SELECT group_id, substr(path, 2) AS path, 'path' AS rule FROM members WHERE doc_id IN (SELECT doc_id FROM toxic) UNION ALL SELECT group_id, CASE WHEN doc_id IN (SELECT doc_id FROM toxic) THEN substr(path, 2) ELSE path END, 'size' FROM members WHERE doc_id IN (SELECT doc_id FROM bad)")
def broken_records(spark, sf_dir):
    m, _ = saved(spark, sf_dir)
    m = flagged(flagged(m, labelled(spark, sf_dir, "toxic", 1), "toxic"), labelled(spark, sf_dir, "quality", 0), "bad")
    none = F.array().cast("array<struct<name:string,size:bigint>>").alias("streams"), F.array().cast("array<struct<name:string,sha256:string>>").alias("stream_hashes")
    record = F.struct(F.when(F.col("toxic"), F.substring("path", 2, 1 << 20)).otherwise(F.col("path")).alias("path"), F.when(F.col("bad"), -1).otherwise(F.col("size")).alias("size"), "modified_ns", "inode", *none)
    return snapshot.violations(m.groupBy("group_id", "digest").agg(F.collect_list(record).alias("files")))


@query(f"WITH {_GROUPS}, {_LABELLED}, l AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS k FROM members WHERE doc_id NOT IN (SELECT doc_id FROM bad)) SELECT group_id, path, size FROM l WHERE k > 1")
def restored_groups(spark, sf_dir):
    m, groups = saved(spark, sf_dir)
    now = m.join(labelled(spark, sf_dir, "quality", 0), "doc_id", "left_anti")
    return snapshot.restore(groups, now)[0].select("group_id", "path", "size")


@query(f"WITH {_GROUPS}, {_LABELLED}, l AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS k, max((path = group_id)::INTEGER) OVER (PARTITION BY group_id) AS ref FROM members WHERE doc_id NOT IN (SELECT doc_id FROM bad)) SELECT group_id, path FROM l WHERE k > 1 AND ref = 1")
def restored_with_references(spark, sf_dir):
    m, groups = saved(spark, sf_dir)
    now = m.join(labelled(spark, sf_dir, "quality", 0), "doc_id", "left_anti")
    return snapshot.restore(groups.withColumn("first", F.col("group_id")), now, reference="first")[0].select("group_id", "path")


@query(f"WITH f AS ({ORACLE_SQL['duplicate_folders']}), gone AS (SELECT '/o/' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS k FROM f WHERE path NOT IN (SELECT path FROM gone)) SELECT group_id, path FROM l WHERE k > 1")
def restored_folders(spark, sf_dir):
    found = cut(QUERIES["duplicate_folders"](spark, sf_dir))
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("path"))
    return session.restored_folders(found, found.join(gone, "path", "left_anti")).select("group_id", "path")


@query(f"WITH m AS ({ORACLE_SQL['image_groups']}), {_LABELLED}, gone AS (SELECT '/i/' || doc_id AS path FROM bad) SELECT reference, path, distance FROM m WHERE path NOT IN (SELECT path FROM gone) AND reference NOT IN (SELECT path FROM gone)")
def restored_matches(spark, sf_dir):
    every = images(spark, sf_dir)
    gone = labelled(spark, sf_dir, "quality", 0).select(F.concat(F.lit("/i/"), F.col("doc_id").cast("string")).alias("path"))
    return session.restored_matches(similar.image_groups(every, 4), every.join(gone, "path", "left_anti"))


# grown results


@query(ORACLE_SQL["image_groups"])
def grown_images(spark, sf_dir):
    """Old signatures are those of labelled documents; the rest are added."""
    every = images(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long"))
    old = table(spark, sf_dir, "labels").select("doc_id").distinct()
    state = grown.scan_media("images", every.join(old, "doc_id", "left_semi").drop("doc_id"), "Strict")
    return grown.extend_media(state, every.join(old, "doc_id", "left_anti").drop("doc_id")).groups


@query(ORACLE_SQL["video_groups"])
def grown_videos(spark, sf_dir):
    every = cut(videos(spark, sf_dir))
    state = grown.scan_media("videos", every.where("path < '/v/5'"), "Balanced")
    return grown.extend_media(state, every.where("path >= '/v/5'")).groups


@query(ORACLE_SQL["duplicate_folders"])
def grown_folders(spark, sf_dir):
    """Files of finished lines are the earlier state, whose sums are used again; the rest are added, those of a held path too, as lines can share one."""
    name = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string"))
    path = F.concat_ws("/", F.lit("/o"), F.col("l_orderkey").cast("string"), name)
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", path.alias("path"), F.col("l_linenumber").cast("long").alias("size"), F.col("l_quantity").cast("long").cast("string").cast("binary").alias("content"))
    old = rows.where("l_linestatus = 'F'").select("path", "size", F.sha2("content", 256).alias("digest"))
    return incremental.extend_folders(incremental.scan_folders(old), rows.where("l_linestatus <> 'F'"), replace=False).groups


@query(f"WITH {_GROUPS}, {_TOXIC}, l AS (SELECT *, count(*) OVER (PARTITION BY text) AS k, min(path) OVER (PARTITION BY text) AS first FROM files WHERE doc_id NOT IN (SELECT doc_id FROM toxic)) SELECT first AS group_id, path, size FROM l WHERE k > 1")
def groups_after_removal(spark, sf_dir):
    f = files(spark, sf_dir)
    gone = f.join(labelled(spark, sf_dir, "toxic", 1), "doc_id", "left_semi").select("path")
    state = incremental.remove(incremental.retained(f, matching()), gone)
    return incremental.members_of(state, matching()).select("group_id", "path", "size")


@query(f"WITH {_FILES}, {_LABELLED} SELECT path, 'changed or gone since it was read' AS reason FROM files WHERE doc_id IN (SELECT doc_id FROM bad)")
def stale_files(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("modified_ns", F.lit(1).cast("long"))
    now = flagged(f, labelled(spark, sf_dir, "quality", 0), "bad").withColumn("modified_ns", F.col("modified_ns") + F.col("bad").cast("int"))
    return incremental.drop_stale(incremental.retained(f, matching("size", evidence="")), now)[1]


@query("SELECT count(*) AS n_files, sum(strlen(text))::BIGINT AS total_bytes FROM documents")
def files_read_so_far(spark, sf_dir):
    f = files(spark, sf_dir)
    return incremental.tally(f.where("path >= '/src5'"), incremental.tally(f.where("path < '/src5'")))


# wide radii, and sizes that no key parts


@query(ORACLE_SQL["image_groups"].replace("<= 4 ", "<= 12 "))
def image_groups_broad(spark, sf_dir):
    return similar.image_groups(images(spark, sf_dir), similar.IMAGE_RADII["Broad"])


@query(ORACLE_SQL["video_groups"].replace("x <= 9)", "x <= 12)").replace("matched >= 10", "matched >= 9").replace("0.015::DOUBLE", "0.03::DOUBLE"))
def video_groups_broad(spark, sf_dir):
    return similar.video_groups(videos(spark, sf_dir), "Broad")


@query(
    "WITH RECURSIVE d AS (SELECT DISTINCT n_chars AS s FROM documents), nxt AS (SELECT a.s, min(b.s) AS t FROM d a JOIN d b ON b.s > a.s + 5 GROUP BY a.s), anchors AS (SELECT min(s) AS anchor FROM d UNION ALL SELECT n.t FROM anchors a JOIN nxt n ON n.s = a.anchor), "
    "m AS (SELECT t.doc_id, max(a.anchor) AS anchor FROM documents t JOIN anchors a ON a.anchor <= t.n_chars GROUP BY t.doc_id) SELECT anchor, count(*) AS n_files, min(doc_id) AS first_id FROM m GROUP BY anchor"
)
def size_sweep(spark, sf_dir):
    swept = tolerance.size_anchors(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [], "n_chars", 5)
    return swept.groupBy("anchor").agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_id"))


# streams, kinds and evidence


_STREAMED = "streamed AS (SELECT m.*, l.doc_id IS NOT NULL AS has, l.quality, l.toxic FROM members m LEFT JOIN labels l USING (doc_id))"


def streamed(spark, sf_dir):
    """Documents as files whose label is a named stream, that of a toxic one not read; and their contents, which are joined with nothing."""
    name = F.lit(":quality:$DATA")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.array(F.struct(name.alias("name"), F.lit(1).cast("long").alias("size"))).alias("streams"),
        F.when(F.col("toxic") == 0, F.array(F.struct(name.alias("name"), F.sha2(F.col("quality").cast("string"), 256).alias("sha256")))).otherwise(F.array()).alias("stream_hashes"),
    )
    none = [F.coalesce(c, F.array()).alias(c) for c in ("streams", "stream_hashes")]
    every = files(spark, sf_dir)
    return every.join(labels, "doc_id", "left").select("doc_id", "path", "size", *none), every.select("path", "content")


@query(
    f"WITH {_GROUPS}, {_STREAMED}, g AS (SELECT group_id, count(*) AS n, count(*) FILTER (has) AS p, bool_and(NOT has OR toxic = 0) AS checked, count(DISTINCT CASE WHEN toxic = 0 THEN quality ELSE 9 END) FILTER (has) AS kinds, sum(size + has::INTEGER)::BIGINT AS total_bytes FROM streamed GROUP BY group_id) "
    "SELECT group_id, checked AS metadata_checked, CASE WHEN p > 0 AND (kinds > 1 OR p < n) THEN ':quality:$DATA' ELSE '' END AS differing, CASE WHEN NOT checked THEN 'Metadata not checked — rescan' WHEN p > 0 AND (kinds > 1 OR p < n) THEN 'Metadata differs' ELSE 'Exact match' END AS status, total_bytes FROM g"
)
def metadata_groups(spark, sf_dir):
    rows, contents = streamed(spark, sf_dir)
    groups = exact.summarize(exact.duplicate_groups(rows, apart=contents))
    return groups.select("group_id", "metadata_checked", F.array_join("differing_streams", ",").alias("differing"), "status", "total_bytes")


@query(f"WITH {_FILES}, s AS (SELECT f.path, f.size, f.text, CASE WHEN l.doc_id IS NULL THEN 'none' WHEN l.toxic = 1 THEN 'unread' ELSE l.quality::VARCHAR END AS held FROM files f LEFT JOIN labels l USING (doc_id)), g AS (SELECT *, min(path) OVER (PARTITION BY text, held) AS group_id, count(*) OVER (PARTITION BY text, held) AS n FROM s) SELECT group_id, path, size FROM g WHERE n > 1")
def stream_groups(spark, sf_dir):
    """Files equal in contents and in all named streams."""
    rows, contents = streamed(spark, sf_dir)
    return exact.duplicate_groups(rows, matching("streams"), apart=contents).select("group_id", "path", "size")


_CONSENT = (
    f"WITH {_GROUPS}, {_STREAMED}, m AS (SELECT *, coalesce(toxic, 0) = 1 AS zone, coalesce(quality, 0) = 1 AS sync FROM streamed), j AS (SELECT a.path, a.group_id, a.zone AND NOT b.zone AS z, a.sync AND NOT b.sync AS s FROM m a JOIN m b ON b.path = a.group_id WHERE a.path <> a.group_id) "
    "SELECT path, group_id, 'copy' AS role, CASE WHEN z THEN 'keep' ELSE 'remove' END AS verdict, CASE WHEN z THEN 'download mark differs; consent needed' END AS reason FROM j"
)


@query(_CONSENT)
def consented_plan(spark, sf_dir):
    """All but the first of each group go; toxic documents carry a download mark, good ones a sync mark, which alone is consented to."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    mark = lambda on, name: F.when(on, F.map_from_arrays(F.array(F.lit(name)), F.array(F.lit("1")))).otherwise(F.create_map().cast("map<string,string>"))
    maps = F.map_concat(mark(F.coalesce(F.col("toxic"), F.lit(0)) == 1, ":Zone.Identifier:$DATA"), mark(F.coalesce(F.col("quality"), F.lit(0)) == 1, ":com.dropbox.attrs:$DATA"))
    m = members(spark, sf_dir).join(labels, "doc_id", "left").withColumns({"stream_map": maps, "is_current": F.lit(True), "contents_verified": F.lit(True)})
    m = cut(m.drop("toxic", "quality"))
    return cleanup.duplicate_plan(m, m.where("path <> group_id").select("path"), allow_dropbox=True)


@query(f"WITH {_TYPED}, g AS (SELECT kind, path, min(path) OVER (PARTITION BY p_brand, p_size) AS group_id, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM (SELECT typed.*, p_brand, p_size FROM typed JOIN part ON regexp_extract(path, '^/p/([0-9]+)', 1)::BIGINT = p_partkey)) SELECT group_id, path FROM g WHERE n > 1 AND kind = 'Images'")
def groups_of_type(spark, sf_dir):
    """Parts of one brand and size are a group; the rows of one category are shown, after groups are made."""
    brand = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("device"), F.col("p_size").cast("long").alias("size"))
    rows = typed(spark, sf_dir).withColumn("p_partkey", F.regexp_extract("path", r"^/p/(\d+)", 1).cast("long")).join(brand, "p_partkey")
    found = exact.duplicate_groups(rows, matching("size", "device", evidence=""))
    return review.of_category(found, "Images").select("group_id", "path")


@query(f"WITH f AS ({ORACLE_SQL['duplicate_folders']}), gone AS (SELECT '/o/' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'P'), l AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS k FROM f WHERE path NOT IN (SELECT path FROM gone)) SELECT group_id, path FROM l WHERE k > 1")
def folders_after_removal(spark, sf_dir):
    """Something in the folders of open orders is removed, which voids them and what lies above."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string"), F.lit("/1")).alias("path"))
    return cleanup.prune_folders(cut(QUERIES["duplicate_folders"](spark, sf_dir)), gone).select("group_id", "path")


@query(f"SELECT reference, path, matched, valid, total FROM ({ORACLE_SQL['video_groups']}) WHERE replace(path, '/v/', '')::BIGINT NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND (replace(path, '/v/', '')::BIGINT IN (SELECT doc_id FROM labels WHERE quality = 0)) = (replace(reference, '/v/', '')::BIGINT IN (SELECT doc_id FROM labels WHERE quality = 0))")
def held_videos(spark, sf_dir):
    """Saved matches whose evidence is checked: records of toxic documents claim another distance, frames of bad ones are inverted, which two that are both so still share."""
    every = cut(videos(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long")))
    found = cut(similar.video_groups(every, "Balanced")).withColumn("doc_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long"))
    claimed = flagged(found, labelled(spark, sf_dir, "toxic", 1), "toxic").withColumn("total", F.col("total") + F.col("toxic").cast("int"))
    changed = flagged(every, labelled(spark, sf_dir, "quality", 0), "bad").withColumn("signatures", F.when(F.col("bad"), F.transform("signatures", lambda s: F.bitwise_not(s))).otherwise(F.col("signatures")))
    return session.held_videos(claimed.select("reference", "path", "matched", "valid", "total"), changed, "Balanced")
