"""Registered queries of the engine's own operators, each with its SQL.

Inputs are the whole tables of the data folder. Where an operator needs an input that no table holds (a status list of Git,
manifests, numbers to format), it is derived from a table by the same rule in both languages.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import identifiers as I
from chunkloom.functions import text as T
from chunkloom.operators import chunking, membership, packages, quality, search
from chunkloom.operators.rules import CrawlRules
from chunkloom.operators.snapshots import clean_entries, git_path, snapshot_changes
from chunkloom.operators.typescript import typescript_chunks
from chunkloom.runtime import table
from chunkloom.schema import STORED_CHUNKS
from chunkloom.sources import git

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- inputs


def points(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Chunks, each point once. Only the named columns are read."""
    wanted = dict.fromkeys(("point_id", "active_label_ids", *columns))
    return membership.distinct_points(table(spark, folder, "chunks").select(*wanted))


POINTS = "points AS (SELECT DISTINCT ON (point_id) * FROM chunks ORDER BY point_id, len(active_label_ids) DESC, active_label_ids DESC)"
MAIN = "orchard-ui:main"


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every path of the snapshots, spelt as Git does."""
    return table(spark, folder, "file_entries").select("catalog", git_path(F.col("relative_path")).alias("relative_path")).distinct()


CLEAN_PATH = r"trim(regexp_replace(regexp_replace('/' || replace(relative_path, '\', '/'), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/')"
PATHS = f"paths AS (SELECT DISTINCT catalog, {CLEAN_PATH} AS relative_path FROM file_entries)"
CLEAN = f"""clean AS (
  SELECT catalog, snapshot_no, path, arg_max(blob, (loaded_at, blob)) AS blob
  FROM (SELECT catalog, snapshot_no, loaded_at, nullif(lower(trim(blob_id)), '') AS blob, {CLEAN_PATH} AS path FROM file_entries)
  WHERE blob IS NOT NULL AND path <> '' GROUP BY ALL
)"""


def _strings(spark: SparkSession, folder: str) -> DataFrame:
    """Names of many kinds, to be judged by the grammars."""
    chunks = table(spark, folder, "chunks")
    kinds = [chunks.select(F.col(c).alias("name")) for c in ("catalog", "package_name", "symbol_name", "relative_path", "breadcrumb", "chunk_kind")]
    kinds += [table(spark, folder, "label_metadata").select(F.col(c).alias("name")) for c in ("label", "label_id", "commit_oid")]
    kinds.append(table(spark, folder, "nation").select(F.col("n_name").alias("name")))
    kinds.append(table(spark, folder, "part").select(F.col("p_name").alias("name")))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.where("name is not null").distinct()


STRINGS = "strings AS (" + " UNION ".join(
    f"SELECT {c} AS name FROM {t} WHERE {c} IS NOT NULL"
    for t, c in (
        *(("chunks", c) for c in ("catalog", "package_name", "symbol_name", "relative_path", "breadcrumb", "chunk_kind")),
        *(("label_metadata", c) for c in ("label", "label_id", "commit_oid")),
        ("nation", "n_name"),
        ("part", "p_name"),
    )
) + ")"

# --- identities and grammars


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", I.content_hash(F.col("text")).alias("content_hash"))


@query("""SELECT DISTINCT point_id, substr(sha256(concat_ws(chr(31), embedder_id, chunker_id, blob_id, relative_path)), 1, 16) AS file_key FROM chunks""")
def file_id(spark, folder):
    key = I.file_id(*(F.col(c) for c in ("embedder_id", "chunker_id", "blob_id", "relative_path")))
    return table(spark, folder, "chunks").select("point_id", key.alias("file_key")).distinct()


@query("SELECT DISTINCT point_id, file_id || ':' || chunk_ordinal AS made FROM chunks")
def point_id(spark, folder):
    return table(spark, folder, "chunks").select("point_id", I.point_id(F.col("file_id"), F.col("chunk_ordinal")).alias("made")).distinct()


@query("SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS blob_id FROM documents WHERE text IS NOT NULL")
def git_blob_id(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", I.git_blob_id(F.col("text")).alias("blob_id"))


_CHARACTER = """CASE WHEN fault = '' THEN NULL WHEN regexp_matches(fault, '^[A-Z]$') THEN '{k}_uppercase' WHEN fault = '_' THEN '{k}_underscore'
  WHEN regexp_matches(fault, '^[{r}]$') THEN '{k}_reserved_char' ELSE '{k}_invalid_char' END"""


def _catalog_case(name: str) -> str:
    character = _CHARACTER.format(k="catalog", r=":@+#=").replace("fault", f"regexp_extract({name}, '([^a-z0-9-])', 1)")
    return f"""CASE WHEN {name} = '' THEN 'catalog_empty' WHEN strlen({name}) > 64 THEN 'catalog_too_long' WHEN {name} LIKE '-%' THEN 'catalog_leading_hyphen'
      WHEN {name} LIKE '%-' THEN 'catalog_trailing_hyphen' WHEN {name} LIKE '%--%' THEN 'catalog_consecutive_hyphens' ELSE {character} END"""


def _label_case(name: str) -> str:
    fault = f"regexp_extract({name}, '^(?:[a-z0-9]+[./=-])*[a-z0-9]*([^a-z0-9])', 1)"
    character = _CHARACTER.format(k="label", r=":@+#").replace("fault", fault)
    return f"""CASE WHEN {name} = '' THEN 'label_empty' WHEN strlen({name}) > 128 THEN 'label_too_long'
      WHEN regexp_full_match({name}, '[a-z0-9]+(?:[./=-][a-z0-9]+)*') THEN NULL WHEN regexp_full_match({name}, '(?:[a-z0-9]+[./=-])+') THEN 'label_trailing_separator'
      WHEN regexp_matches({fault}, '^[./=-]$') THEN 'label_leading_separator' ELSE {character} END"""


@query(f"WITH {STRINGS} SELECT name, {_catalog_case('name')} AS code FROM strings")
def validate_catalog(spark, folder):
    return _strings(spark, folder).select("name", I.catalog_error(F.col("name")).alias("code"))


@query(f"WITH {STRINGS} SELECT name, {_label_case('name')} AS code FROM strings")
def validate_label(spark, folder):
    return _strings(spark, folder).select("name", I.label_error(F.col("name")).alias("code"))


_CAT, _LAB = "split_part(name, ':', 1)", "substr(name, instr(name, ':') + 1)"


@query(
    f"""WITH {STRINGS} SELECT name, CASE WHEN contains(name, ':') THEN {_CAT} END AS catalog, CASE WHEN contains(name, ':') THEN {_LAB} END AS label,
  CASE WHEN NOT contains(name, ':') THEN 'label_id_no_colon' ELSE coalesce({_catalog_case(_CAT)}, {_label_case(_LAB)}) END AS code FROM strings"""
)
def parse_label_id(spark, folder):
    name = F.col("name")
    return _strings(spark, folder).select(
        "name", I.label_id_catalog(name).alias("catalog"), I.label_id_label(name).alias("label"), I.label_id_error(name).alias("code")
    )


@query(
    f"""WITH {POINTS}, judged AS (
  SELECT point_id, coalesce({_catalog_case('catalog')},
    CASE WHEN len(active_label_ids) < 1 THEN 'labels_empty' END,
    CASE WHEN len(list_filter(active_label_ids, lambda x: NOT regexp_full_match(x, '[a-z0-9]+(?:-[a-z0-9]+)*:[a-z0-9]+(?:[./=-][a-z0-9]+)*'))) > 0 THEN 'label_invalid' END,
    CASE WHEN chunk_ordinal < 1 OR chunk_ordinal > chunk_count THEN 'ordinal_out_of_range' END,
    CASE WHEN point_id <> file_id || ':' || chunk_ordinal THEN 'point_id_mismatch' END, 'valid') AS error FROM points)
SELECT error, count(*) AS rows FROM judged GROUP BY error"""
)
def validate_rows(spark, folder):
    rows = points(spark, folder, "catalog", "chunk_ordinal", "chunk_count", "file_id")
    bad = F.exists("active_label_ids", lambda x: ~x.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*:[a-z0-9]+(?:[./=-][a-z0-9]+)*$"))
    judged = membership.row_errors(rows, I.catalog_error(F.col("catalog")), F.when(bad, "label_invalid"))
    return judged.groupBy(F.coalesce("error", F.lit("valid")).alias("error")).agg(F.count("*").alias("rows"))


# --- text


def _encoded(x: str) -> str:
    for c in "%:@=+#":
        x = f"replace({x}, '{c}', '%{ord(c):02X}')"
    for c in " \t\n\r":
        x = f"replace({x}, chr({ord(c)}), '%{ord(c):02X}')"
    return x


@query(f"WITH {STRINGS} SELECT name, {_encoded('name')} AS encoded FROM strings")
def encode_path(spark, folder):
    return _strings(spark, folder).select("name", T.encode_path(F.col("name")).alias("encoded"))


@query(
    r"""SELECT heading, replace(regexp_replace(lower(heading), '[^\p{L}\p{N}\p{M}\p{Pc} -]', '', 'g'), ' ', '-') AS slug
  FROM (SELECT DISTINCT symbol_name AS heading FROM chunks WHERE symbol_name IS NOT NULL UNION SELECT p_name FROM part)"""
)
def heading_slugs(spark, folder):
    headings = table(spark, folder, "chunks").select(F.col("symbol_name").alias("heading")).unionByName(table(spark, folder, "part").select(F.col("p_name").alias("heading")))
    return headings.where("heading is not null").distinct().select("heading", T.slug(F.col("heading")).alias("slug"))


_FILE_NAME = "split_part(relative_path, '/', -1)"


@query(
    f"""SELECT DISTINCT point_id, concat_ws(':', nullif({_encoded('package_name')}, ''), {_encoded(_FILE_NAME)}, nullif({_encoded('symbol_name')}, '')) AS crumb FROM chunks"""
)
def breadcrumb(spark, folder):
    crumb = T.breadcrumb(F.col("package_name"), T.file_name(F.col("relative_path")), F.col("symbol_name"))
    return table(spark, folder, "chunks").select("point_id", crumb.alias("crumb")).distinct()


@query(
    """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM s"""
)
def format_duration(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", T.format_duration(F.col("o_totalprice")).alias("duration"))


@query(
    """WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40000) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE b || ' bytes' END AS size FROM b"""
)
def format_bytes(spark, folder):
    size = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 40000)
    return table(spark, folder, "orders").select("o_orderkey", T.format_bytes(size).alias("size"))


_LINES = r"""(CASE WHEN text = '' THEN [] WHEN regexp_matches(text, '\n$') THEN regexp_split_to_array(text, '\r?\n')[:-2] ELSE regexp_split_to_array(text, '\r?\n') END)"""


@query(f"SELECT doc_id, len(lines) AS lines, md5(array_to_string(lines, '|')) AS digest FROM (SELECT doc_id, {_LINES} AS lines FROM documents WHERE text IS NOT NULL)")
def split_lines(spark, folder):
    lines = T.split_lines(F.col("text"))
    return (
        table(spark, folder, "documents")
        .where("text is not null")
        .select("doc_id", lines.alias("l"))
        .select("doc_id", F.size("l").alias("lines"), F.md5(F.array_join("l", "|").cast("binary")).alias("digest"))
    )


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def sanitize(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(T.sanitize(F.col("text")).cast("binary")).alias("digest"))


@query(
    f"""WITH {POINTS} SELECT point_id, coalesce(breadcrumb, 'unknown') || CASE WHEN split_part_ordinal IS NOT NULL AND split_part_count IS NOT NULL
  THEN ' (part ' || split_part_ordinal || '/' || split_part_count || ')' ELSE '' END || CASE WHEN chunk_kind <> 'content' THEN ' [' || chunk_kind || ']' ELSE '' END AS line FROM points"""
)
def report_line(spark, folder):
    rows = points(spark, folder, "breadcrumb", "split_part_ordinal", "split_part_count", "chunk_kind")
    line = T.report_line(F.col("breadcrumb"), F.col("split_part_ordinal"), F.col("split_part_count"), F.col("chunk_kind"))
    return rows.select("point_id", line.alias("line"))


@query(f"""SELECT DISTINCT point_id, array_to_string(list_transform({_LINES}[1:3], lambda x: '> ' || x), chr(10)) AS blurb FROM chunks""")
def search_blurb(spark, folder):
    return table(spark, folder, "chunks").select("point_id", T.blurb(F.col("text")).alias("blurb")).distinct()


# --- rules and packages

_RULES = CrawlRules()


def _rule_sql(path: str) -> str:
    def matches(patterns):
        folders = [p for p in patterns if p.endswith("/")]
        ends = [p.removeprefix("**/*") for p in patterns if p.startswith("**/*")]
        names = [p.removeprefix("**/") for p in patterns if p.startswith("**/") and not p.startswith("**/*")]
        tests = [f"contains('/' || {path}, '/{p}')" for p in folders] + [f"ends_with({path}, '{e}')" for e in ends] + [f"ends_with('/' || {path}, '/{n}')" for n in names]
        return "(" + " OR ".join(tests) + ")"

    typed = "(" + " OR ".join(f"ends_with({path}, '{s}')" for s in _RULES.file_types) + ")"
    return f"({typed} AND ({matches(_RULES.keep)} OR NOT {matches(_RULES.exclude)}))"


_STRATEGY = "CASE " + " ".join(
    f"WHEN ends_with(relative_path, '{s}') THEN '{t}'" for s, t in sorted(_RULES.file_types.items(), key=lambda x: (-len(x[0]), x[0]))
) + " END"


@query(f"WITH {PATHS} SELECT catalog, relative_path, {_rule_sql('relative_path')} AS crawl FROM paths")
def should_crawl(spark, folder):
    return paths(spark, folder).select("catalog", "relative_path", _RULES.should_crawl(F.col("relative_path")).alias("crawl"))


@query(f"WITH {PATHS} SELECT catalog, relative_path, NOT {_rule_sql('relative_path')} AS skip FROM paths")
def skip_path(spark, folder):
    return paths(spark, folder).select("catalog", "relative_path", (~_RULES.should_crawl(F.col("relative_path"))).alias("skip"))


@query(f"WITH {PATHS} SELECT catalog, relative_path, {_STRATEGY} AS strategy FROM paths")
def strategy(spark, folder):
    return paths(spark, folder).select("catalog", "relative_path", _RULES.strategy(F.col("relative_path")).alias("strategy"))


@query(
    f"""SELECT {_STRATEGY} AS strategy, count(DISTINCT point_id) AS texts, count(DISTINCT point_id) FILTER (regexp_matches(text, '\\S')) AS cut FROM chunks WHERE {_STRATEGY} IS NOT NULL GROUP BY 1"""
)
def chunk_dispatch(spark, folder):
    """Every text goes to the cutter of its strategy, and all but blank ones are cut."""
    from chunkloom.plans.crawl import cut_files

    texts = table(spark, folder, "chunks").select("point_id", "relative_path", F.coalesce("package_name", F.lit("")).alias("package"), "text").dropDuplicates(["point_id"])
    cut = cut_files(texts, _RULES).groupBy(_RULES.strategy(F.col("relative_path")).alias("strategy")).agg(F.countDistinct("point_id").alias("cut"))
    return texts.groupBy(_RULES.strategy(F.col("relative_path")).alias("strategy")).agg(F.count("*").alias("texts")).where("strategy is not null").join(cut, "strategy")


def _manifests(spark, folder):
    """A manifest for every package folder (the first two parts of a path) that chunks tell of."""
    top = F.substring_index("relative_path", "/", 2)
    found = table(spark, folder, "chunks").select("catalog", top.alias("dir"), "package_name").distinct()
    body = F.to_json(F.struct(F.struct(F.lit("nested").alias("name")).alias("inner"), F.col("package_name").alias("name")))
    return found.select("catalog", F.concat("dir", F.lit("/package.json")).alias("path"), body.alias("text"))


@query("SELECT string_split(relative_path, '/')[1] || '/' || string_split(relative_path, '/')[2] AS dir, max(package_name) AS name FROM chunks GROUP BY 1")
def package_index(spark, folder):
    return packages.package_index(_manifests(spark, folder))


@query(
    f"""WITH {PATHS}, packs AS (SELECT string_split(relative_path, '/')[1] || '/' || string_split(relative_path, '/')[2] AS dir, max(package_name) AS name FROM chunks GROUP BY 1)
SELECT p.catalog, p.relative_path, coalesce(k.name, p.catalog) AS package FROM paths p
LEFT JOIN packs k ON k.dir = array_to_string(string_split(p.relative_path, '/')[1:2], '/') AND len(string_split(p.relative_path, '/')) > 2"""
)
def package_lookup(spark, folder):
    index = packages.package_index(_manifests(spark, folder))
    return packages.nearest_package(paths(spark, folder), index, "relative_path", F.col("catalog"))


# --- chunking


@query(
    f"""WITH RECURSIVE docs AS (SELECT doc_id, {_LINES} AS lines FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, lines[i] AS line, strlen(lines[i]) AS b FROM docs, unnest(range(1, len(lines) + 1)) AS u(i)),
f AS (
  SELECT doc_id, 1 AS i, 1 AS chunk, b AS size, line FROM (SELECT doc_id, line, i, b FROM n WHERE i = 1)
  UNION ALL
  SELECT f.doc_id, n.i, CASE WHEN f.size + 1 + n.b < 6000 THEN f.chunk ELSE f.chunk + 1 END,
    CASE WHEN f.size + 1 + n.b < 6000 THEN f.size + 1 + n.b ELSE n.b END, n.line
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1
),
c AS (SELECT doc_id, chunk, min(i) AS start_line, max(i) AS end_line, string_agg(line, chr(10) ORDER BY i) AS t FROM f GROUP BY doc_id, chunk),
k AS (SELECT * FROM c WHERE regexp_matches(t, '\\S'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS INT) AS chunk_ordinal, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS chunk_count,
  start_line, end_line, md5(t) AS digest FROM k"""
)
def line_chunks(spark, folder):
    cut = chunking.line_chunks(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "chunk_ordinal", "chunk_count", "start_line", "end_line", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query(
    f"""WITH docs AS (SELECT doc_id, {_LINES} AS lines FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, trim(lines[i], chr(32) || chr(9) || chr(13)) AS line, len(lines) AS total FROM docs, unnest(range(1, len(lines) + 1)) AS u(i)),
fenced AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS code FROM n),
h AS (SELECT * FROM fenced WHERE code = 0 AND starts_with(line, '#')),
s AS (SELECT doc_id, i AS start_line, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, total) AS end_line, nullif(trim(ltrim(line, '#')), '') AS heading FROM h),
g AS (SELECT *, replace(regexp_replace(lower(heading), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}} -]', '', 'g'), ' ', '-') AS base FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY start_line) - 1 AS again FROM g)
SELECT doc_id, start_line, CAST(end_line AS INT) AS end_line, heading, CASE WHEN again > 0 AND base IS NOT NULL THEN base || '-' || again ELSE base END AS slug FROM u
UNION ALL SELECT doc_id, 1, CAST(len(lines) AS INT), NULL, NULL FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM h) AND regexp_matches(array_to_string(lines, chr(10)), '\\S')"""
)
def md_sections(spark, folder):
    return chunking.markdown_sections(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "start_line", "end_line", "heading", "slug")


@query(
    f"""WITH RECURSIVE docs AS (SELECT doc_id, {_LINES} AS lines FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, lines[i] AS line, trim(lines[i], chr(32) || chr(9) || chr(13)) AS bare, strlen(lines[i]) + 1 AS b, len(lines) AS total FROM docs, unnest(range(1, len(lines) + 1)) AS u(i)),
fenced AS (SELECT *, sum(CASE WHEN starts_with(bare, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS code FROM n),
h AS (SELECT doc_id, i AS a, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, total) AS z, nullif(trim(ltrim(bare, '#')), '') AS heading FROM fenced WHERE code = 0 AND starts_with(bare, '#')),
s AS (SELECT h.*, sum(b) - 1 AS size, string_agg(line, chr(10) ORDER BY i) AS t FROM h JOIN n ON n.doc_id = h.doc_id AND n.i BETWEEN a AND z GROUP BY ALL),
m AS (SELECT n.*, s.a FROM n JOIN s ON s.doc_id = n.doc_id AND n.i BETWEEN s.a AND s.z WHERE s.size > 600),
r AS (
  SELECT doc_id, a, i, line, b AS size, 1 AS part, CASE WHEN starts_with(bare, '```') THEN 1 ELSE 0 END AS code, b AS psize, 1 AS ppart FROM m WHERE i = a
  UNION ALL
  SELECT doc_id, a, i, line, CASE WHEN cut THEN b ELSE size + b END, part + CASE WHEN cut THEN 1 ELSE 0 END, code, CASE WHEN psize + b > 600 THEN b ELSE psize + b END, ppart + CASE WHEN psize + b > 600 THEN 1 ELSE 0 END
  FROM (
    SELECT m.doc_id, m.a, m.i, m.line, m.b, r.size, r.part, r.psize, r.ppart, x.code,
      r.size + m.b > 600 AND x.code = 0 AND (m.bare = '' OR regexp_matches(m.bare, '^(?:```|[>*-])')) AS cut
    FROM r JOIN m ON m.doc_id = r.doc_id AND m.a = r.a AND m.i = r.i + 1, LATERAL (SELECT CASE WHEN starts_with(m.bare, '```') THEN 1 - r.code ELSE r.code END AS code) x
  )
),
p AS (SELECT *, max(part) OVER (PARTITION BY doc_id, a) AS parts, max(ppart) OVER (PARTITION BY doc_id, a) AS pparts FROM r),
q AS (SELECT doc_id, min(i) AS start_line, max(i) AS end_line, parts = 1 AS plain, CASE WHEN parts = 1 THEN ppart ELSE part END AS k, CASE WHEN parts = 1 THEN pparts ELSE parts END AS c, string_agg(line, chr(10) ORDER BY i) AS t
  FROM p GROUP BY doc_id, a, parts, pparts, CASE WHEN parts = 1 THEN ppart ELSE part END)
SELECT doc_id, start_line, end_line, CASE WHEN plain THEN 'markdown' ELSE 'section' END AS chunk_type, NULL AS symbol_name, k AS split_part_ordinal, c AS split_part_count, md5(t) AS digest FROM q WHERE regexp_matches(t, '\\S')
UNION ALL SELECT doc_id, a, z, 'section', heading, NULL, NULL, md5(t) FROM s WHERE size <= 600
UNION ALL SELECT doc_id, 1, len(lines), 'markdown', NULL, NULL, NULL, md5(array_to_string(lines, chr(10))) FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM h) AND regexp_matches(array_to_string(lines, chr(10)), '\\S')"""
)
def md_split_parts(spark, folder):
    cut = chunking.markdown_chunks(table(spark, folder, "documents").select("doc_id", "text"), limit=600)
    return cut.select("doc_id", "start_line", "end_line", "chunk_type", "symbol_name", "split_part_ordinal", "split_part_count", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query()
def ts_chunks(spark, folder):
    """The chunks' own texts, cut once more along their syntax to pieces of 2,000 bytes."""
    scripts = table(spark, folder, "chunks").where(F.col("relative_path").rlike("[.]tsx?$")).select("point_id", "relative_path", "text").dropDuplicates(["point_id"])
    cut = typescript_chunks(scripts, limit=2000)
    return cut.select("point_id", "start_line", "end_line", "chunk_type", "chunk_kind", "symbol_name", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query("SELECT DISTINCT point_id, md5(regexp_replace(text, '\\s', '', 'g')) AS digest, true AS numbered FROM chunks WHERE regexp_matches(relative_path, '[.]tsx?$') AND regexp_matches(text, '\\S')")
def ts_rebuilt(spark, folder):
    """The pieces of every script put together again: nothing is lost or repeated, and lines don't overlap."""
    scripts = table(spark, folder, "chunks").where(F.col("relative_path").rlike("[.]tsx?$")).select("point_id", "relative_path", "text").dropDuplicates(["point_id"])
    pieces = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "chunk_text")))
    cut = typescript_chunks(scripts, limit=2000).groupBy("point_id").agg(pieces.alias("p"))  # the pieces of one text
    rising = F.aggregate("p", F.struct(F.lit(0).alias("end"), F.lit(True).alias("ok")), lambda s, x: F.struct(x["end_line"].alias("end"), (s["ok"] & (x["start_line"] > s["end"]) & (x["end_line"] >= x["start_line"])).alias("ok")))
    return cut.select("point_id", F.md5(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["chunk_text"]), ""), r"\s", "").cast("binary")).alias("digest"), rising["ok"].alias("numbered"))


@query(f"WITH {PATHS} SELECT catalog, relative_path FROM paths WHERE ends_with(relative_path, '.ts') ORDER BY md5('7:' || catalog || ':' || relative_path), catalog, relative_path LIMIT 20")
def sample_files(spark, folder):
    """A repeatable sample of 20 script files: the sampling operator of the audit."""
    scripts = paths(spark, folder).where(F.col("relative_path").endswith(".ts"))
    return scripts.orderBy(F.md5(F.concat_ws(":", F.lit("7"), "catalog", "relative_path").cast("binary")), "catalog", "relative_path").limit(20)


@query(
    f"""WITH {POINTS} SELECT point_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start_line, point_id) AS INT) AS made_ordinal, CAST(count(*) OVER (PARTITION BY file_id) AS INT) AS made_count FROM points"""
)
def chunk_ordinals(spark, folder):
    rows = points(spark, folder, "file_id", "start_line").select("point_id", "file_id", F.struct("start_line", "point_id").alias("start_line"))
    return chunking.chunk_ordinals(rows).select("point_id", F.col("chunk_ordinal").alias("made_ordinal"), F.col("chunk_count").alias("made_count"))


_REPORT = f"""WITH {POINTS}, s AS (SELECT file_id, strlen(text) AS size FROM points),
t AS (SELECT file_id, count(*) AS chunks, count(*) FILTER (size < 500) AS small_chunks, min(size) AS min_bytes, max(size) AS max_bytes, avg(size) AS mean_bytes,
  sum(size)::DOUBLE AS total, least(6000, sum(size))::DOUBLE AS m FROM s GROUP BY file_id),
b AS (SELECT t.file_id, sum(CASE WHEN size >= m THEN greatest(size / m, 1) ELSE ((m - size) / (m - 1)) ** 2 END) AS bad FROM s JOIN t USING (file_id) GROUP BY 1),
i AS (SELECT *, ceil(total / m) AS ideal FROM t JOIN b USING (file_id)),
l AS (SELECT *, total - m * (ideal - 1) AS last FROM i),
e AS (SELECT *, (CASE WHEN last >= m THEN greatest(last / m, 1) ELSE ((m - last) / (m - 1)) ** 2 END) / greatest(ideal, 1) AS least_bad FROM l),
r AS (SELECT *, 100 * (1 - least(1, greatest(0, CASE WHEN total = ideal THEN 0 ELSE (chunks - ideal) / (total - ideal) END)))
  * (1 - least(1, greatest(0, CASE WHEN least_bad = 1 THEN 0 ELSE (bad / chunks - least_bad) / (1 - least_bad) END))) AS score FROM e)
"""


def _report(spark, folder):
    return quality.quality_report(points(spark, folder, "file_id", "text"))


@query(_REPORT + "SELECT file_id, chunks, small_chunks, min_bytes, max_bytes, round(mean_bytes, 6) AS mean_bytes FROM r")
def quality_report(spark, folder):
    return _report(spark, folder).select("file_id", "chunks", "small_chunks", "min_bytes", "max_bytes", F.round("mean_bytes", 6).alias("mean_bytes"))


@query(_REPORT + "SELECT file_id, round(score, 6) + 0 AS score FROM r")
def quality_score(spark, folder):
    return _report(spark, folder).select("file_id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query(_REPORT + "SELECT file_id, round(score, 6) + 0 AS score FROM r ORDER BY round(score, 9), file_id LIMIT 3")
def audit_worst(spark, folder):
    scored = _report(spark, folder).withColumn("score", F.round("score", 9))
    return quality.worst_files(scored).select("file_id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query(
    f"""WITH {POINTS} SELECT count(*) AS chunks, CAST(sum(strlen(text) + coalesce(strlen(breadcrumb), 0)) AS BIGINT) AS total_bytes,
  round(avg(strlen(text) + coalesce(strlen(breadcrumb), 0)), 6) AS mean_bytes, count(*) FILTER (strlen(text) > 6000) AS oversized, count(*) FILTER (strlen(text) < 200) AS undersized FROM points"""
)
def dump_summary(spark, folder):
    return quality.dump_summary(points(spark, folder, "text", "breadcrumb")).withColumn("mean_bytes", F.round("mean_bytes", 6))


# --- lookups and search

_FIRST_FILE = "(SELECT min(file_id) FROM chunks)"


def _first_file(spark, folder) -> str:
    return table(spark, folder, "chunks").agg(F.min("file_id")).head()[0]


@query("SELECT DISTINCT point_id, file_id, relative_path, chunk_ordinal FROM chunks WHERE point_id = (SELECT min(point_id) FROM chunks)")
def point_lookup(spark, folder):
    chunks = table(spark, folder, "chunks")
    wanted = chunks.agg(F.min("point_id")).head()[0]
    return chunks.where(F.col("point_id") == wanted).limit(1).select("point_id", "file_id", "relative_path", "chunk_ordinal")


_VIEW = f"WITH {POINTS} SELECT point_id, chunk_ordinal, start_line, end_line FROM points WHERE file_id = {_FIRST_FILE}"


def _viewed(spark, folder, first=1, last=None, label_id=None):
    rows = points(spark, folder, "file_id", "chunk_ordinal", "start_line", "end_line", "catalog")
    return search.view(rows, [search.Selection(_first_file(spark, folder), first, last)], label_id).select("point_id", "chunk_ordinal", "start_line", "end_line")


@query(_VIEW)
def file_chunks(spark, folder):
    return _viewed(spark, folder)


@query(_VIEW + f" AND list_contains(active_label_ids, (SELECT min(l) FROM (SELECT unnest(active_label_ids) AS l FROM chunks WHERE file_id = {_FIRST_FILE})))")
def view_file(spark, folder):
    first = _first_file(spark, folder)
    label = table(spark, folder, "chunks").where(F.col("file_id") == first).select(F.explode("active_label_ids").alias("l")).agg(F.min("l")).head()[0]
    return _viewed(spark, folder, label_id=label)


@query(_VIEW + " AND chunk_ordinal = 1")
def view_single(spark, folder):
    return _viewed(spark, folder, 1, 1)


@query(_VIEW + " AND chunk_ordinal BETWEEN 1 AND 3")
def view_range(spark, folder):
    return _viewed(spark, folder, 1, 3)


@query(_VIEW + " AND chunk_ordinal >= 2")
def view_to_end(spark, folder):
    return _viewed(spark, folder, 2)


@query("SELECT DISTINCT c.catalog, count(DISTINCT m.label) AS labels FROM (SELECT catalog FROM chunks UNION SELECT catalog FROM file_entries) c LEFT JOIN label_metadata m USING (catalog) GROUP BY 1")
def view_catalogs(spark, folder):
    """The preamble of a view: every configured catalog (here those of chunks and snapshots), with its number of labels."""
    configured = table(spark, folder, "chunks").select("catalog").unionByName(table(spark, folder, "file_entries").select("catalog"))
    return search.view_catalogs(configured, table(spark, folder, "label_metadata"))


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE list_contains(active_label_ids, '{MAIN}')")
def label_scan(spark, folder):
    return points(spark, folder).where(F.array_contains("active_label_ids", MAIN)).select("point_id")


@query(f"WITH {POINTS} SELECT point_id, file_complete FROM points WHERE list_contains(active_label_ids, '{MAIN}') AND chunk_ordinal = 1")
def sentinel_scan(spark, folder):
    return points(spark, folder, "chunk_ordinal", "file_complete").where(F.array_contains("active_label_ids", MAIN) & (F.col("chunk_ordinal") == 1)).select("point_id", "file_complete")


@query("SELECT label_id, commit_oid, crawl_complete FROM label_metadata WHERE catalog = 'orchard-ui'")
def labels_for_catalog(spark, folder):
    return table(spark, folder, "label_metadata").where("catalog = 'orchard-ui'").select("label_id", "commit_oid", "crawl_complete")


@query(
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(v::DOUBLE[], v::DOUBLE[])), 6) + 0 AS distance
FROM embeddings, q ORDER BY 2, 1 LIMIT 10"""
)
def embedding_search(spark, folder):
    rows = table(spark, folder, "embeddings")
    wanted = rows.orderBy("vec_id").select("embedding").head()[0]
    found = rows.select("vec_id", F.lit(None).cast("array<string>").alias("active_label_ids"), "embedding")
    return search.vector_search(found, wanted, k=10, id_column="vec_id", vector="embedding").select("vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(
    f"""WITH {POINTS}, usable AS (SELECT *, vector::DOUBLE[] AS d FROM points WHERE len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
q AS (SELECT d AS v FROM usable WHERE point_id = (SELECT min(point_id) FROM usable))
SELECT point_id, round(1 - list_dot_product(d, v) / sqrt(list_dot_product(d, d) * list_dot_product(v, v)), 6) + 0 AS distance
FROM usable, q WHERE list_contains(active_label_ids, '{MAIN}') ORDER BY 1 - list_dot_product(d, v) / sqrt(list_dot_product(d, d) * list_dot_product(v, v)), point_id LIMIT 10"""
)
def vector_search(spark, folder):
    chunks = table(spark, folder, "chunks").select("point_id", "active_label_ids", "vector")
    whole = (F.size("vector") == 64) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    wanted = chunks.where(whole).agg(F.min_by("vector", "point_id")).head()[0]
    return search.vector_search(chunks, wanted, MAIN, 10, repeated=True).select("point_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


# --- incremental work and membership


def _last_files(spark, folder):
    """The files of the last snapshot of every catalog, with the ``file_id`` that chunks of the same content at the same path have."""
    clean = clean_entries(table(spark, folder, "file_entries"))
    last = clean.groupBy("catalog").agg(F.max("snapshot_no").alias("snapshot_no"))
    known = table(spark, folder, "chunks").select("catalog", "relative_path", F.col("blob_id").alias("blob"), "file_id").groupBy("catalog", "relative_path", "blob").agg(F.min("file_id").alias("file_id"))
    return clean.join(last, ["catalog", "snapshot_no"]).join(known, ["catalog", "relative_path", "blob"], "left").select("catalog", "relative_path", "blob", "file_id")


_LAST = f"""WITH {CLEAN}, lastno AS (SELECT catalog, max(snapshot_no) AS snapshot_no FROM clean GROUP BY 1),
known AS (SELECT catalog, relative_path AS path, blob_id AS blob, min(file_id) AS file_id FROM chunks GROUP BY ALL),
files AS (SELECT c.catalog, c.path AS relative_path, c.blob, k.file_id FROM clean c JOIN lastno USING (catalog, snapshot_no) LEFT JOIN known k USING (catalog, path, blob)),
sentinel AS (SELECT file_id, bool_or(file_complete) AS complete FROM chunks WHERE chunk_ordinal = 1 GROUP BY 1),
warned AS (SELECT DISTINCT relative_path FROM chunks WHERE chunk_kind = 'fallback-split'),
status AS (SELECT f.*, CASE WHEN s.complete THEN 'existing' WHEN s.complete IS NOT NULL THEN 'incomplete' ELSE 'new' END AS status FROM files f LEFT JOIN sentinel s USING (file_id))
"""


def _classified(spark, folder, forced=None):
    return membership.incremental_classify(_last_files(spark, folder), table(spark, folder, "chunks"), forced)


@query(_LAST + "SELECT catalog, relative_path, status FROM status")
def incremental_classify(spark, folder):
    return _classified(spark, folder).select("catalog", "relative_path", "status")


@query(_LAST + "SELECT catalog, relative_path, CASE WHEN relative_path IN (SELECT relative_path FROM warned) THEN 'new' ELSE status END AS status FROM status")
def force_reprocess(spark, folder):
    return _classified(spark, folder, membership.warning_files(table(spark, folder, "chunks"))).select("catalog", "relative_path", "status")


@query(_LAST + "SELECT catalog, status, count(*) AS files FROM status GROUP BY ALL")
def crawl_counts(spark, folder):
    return _classified(spark, folder).groupBy("catalog", "status").agg(F.count("*").alias("files"))


@query("SELECT file_id, count(DISTINCT chunk_ordinal) AS chunks, max(chunk_count) AS chunk_count, count(DISTINCT chunk_ordinal) = max(chunk_count) AS complete FROM chunks GROUP BY file_id")
def file_complete(spark, folder):
    return membership.file_complete(table(spark, folder, "chunks"))


@query("SELECT file_id FROM chunks WHERE catalog = 'tidewater' UNION SELECT file_id FROM incoming_chunks WHERE catalog = 'tidewater'")
def touched_files(spark, folder):
    sets = [table(spark, folder, t).where("catalog = 'tidewater'").select("file_id") for t in ("chunks", "incoming_chunks")]
    return sets[0].unionByName(sets[1]).distinct()


_NEW_LABEL = "orchard-ui:release/next"


@query(
    _LAST.replace("WITH clean", f"WITH {POINTS}, clean", 1)
    + f"""SELECT point_id, array_to_string(CASE WHEN list_contains(active_label_ids, '{_NEW_LABEL}') THEN active_label_ids ELSE list_append(active_label_ids, '{_NEW_LABEL}') END, ',') AS labels
  FROM points WHERE file_id IN (SELECT file_id FROM status WHERE status = 'existing' AND catalog = 'orchard-ui')"""
)
def label_add(spark, folder):
    existing = _classified(spark, folder).where("status = 'existing' and catalog = 'orchard-ui'")
    return membership.label_add(points(spark, folder, "file_id"), existing, _NEW_LABEL).select("point_id", F.array_join("active_label_ids", ",").alias("labels"))


@query(
    _LAST.replace("WITH clean", f"WITH {POINTS}, clean", 1)
    + f"""SELECT point_id, array_to_string(labels, ',') AS labels FROM (SELECT point_id, CASE WHEN list_contains(active_label_ids, '{MAIN}')
  AND file_id NOT IN (SELECT file_id FROM files WHERE file_id IS NOT NULL) THEN list_filter(active_label_ids, lambda x: x <> '{MAIN}') ELSE active_label_ids END AS labels FROM points) WHERE len(labels) > 0"""
)
def label_cleanup(spark, folder):
    touched = _last_files(spark, folder).where("file_id is not null")
    return membership.label_cleanup(points(spark, folder, "file_id"), touched, MAIN).select("point_id", F.array_join("active_label_ids", ",").alias("labels"))


def _database(spark, folder):
    """A database of the chunks as a crawl would have left it: contents, the files of each label, and the labels."""
    from chunkloom.runtime import Scratch, mounted_path
    from chunkloom.sources.warehouse import Warehouse

    root = mounted_path(spark, Scratch(spark, "database").path)
    os.makedirs(root)
    store = Warehouse.create(spark, f"{root}/db", vector_dim=64)
    rows = points(spark, folder, *(c for c in STORED_CHUNKS.names if c not in ("point_id", "vector"))).withColumn("vector", F.lit(None).cast("array<float>"))
    store.upsert_files(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED_CHUNKS.fields)))
    label = F.explode("active_label_ids").alias("id")
    members = points(spark, folder, "file_id").select("file_id", label).select("file_id", I.label_id_catalog(F.col("id")).alias("catalog"), I.label_id_label(F.col("id")).alias("label"))
    store.add_members(members)
    return store


_UPSERT = f"""WITH {POINTS}, src AS (SELECT point_id, file_id, text, blob_id FROM incoming_chunks WHERE incoming_id IN (SELECT max(incoming_id) FROM incoming_chunks GROUP BY point_id))
SELECT point_id, md5(text) AS digest, blob_id FROM points WHERE file_id NOT IN (SELECT file_id FROM src) UNION ALL SELECT point_id, md5(text), blob_id FROM src"""


@query(_UPSERT)
def upsert_chunks(spark, folder):
    """The files of the incoming chunks take the place of those that the database has."""
    store = _database(spark, folder)
    rest = [c for c in STORED_CHUNKS.names if c not in ("point_id", "vector")]
    last = table(spark, folder, "incoming_chunks").groupBy("point_id").agg(F.max_by(F.struct(*rest), "incoming_id").alias("r")).select("point_id", "r.*").withColumn("vector", F.lit(None).cast("array<float>"))
    store.upsert_files(last.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" and not f.nullable else F.col(f.name) for f in STORED_CHUNKS.fields)))
    return store.stored_chunks().select("point_id", F.md5(F.col("text").cast("binary")).alias("digest"), "blob_id")


@query(f"WITH {POINTS} SELECT point_id FROM points WHERE point_id NOT IN (SELECT point_id FROM incoming_chunks)")
def delete_by_ids(spark, folder):
    return membership.delete_by_ids(points(spark, folder).select("point_id"), table(spark, folder, "incoming_chunks"))


@query(
    f"""WITH {POINTS} SELECT 'sabledocs' AS purged, count(*) AS before_rows, count(*) FILTER (catalog <> 'sabledocs') AS after_rows, count(*) FILTER (catalog = 'sabledocs') AS deleted,
  (SELECT count(DISTINCT file_id || l) FROM (SELECT file_id, unnest(active_label_ids) AS l FROM points) WHERE NOT starts_with(l, 'sabledocs:')) AS members FROM points"""
)
def purge_catalog(spark, folder):
    store = _database(spark, folder)
    before = store.stored_chunks().count()
    deleted, _ = store.purge("sabledocs")
    counted = store.stored_chunks().agg(F.count("*").alias("after_rows"))
    members = store.membership().agg(F.count("*").alias("members"))
    return counted.crossJoin(F.broadcast(members)).select(F.lit("sabledocs").alias("purged"), F.lit(before).alias("before_rows"), "after_rows", F.lit(deleted).alias("deleted"), "members")  # single rows


@query(f"WITH {POINTS} SELECT count(*) AS before_rows, CAST(0 AS BIGINT) AS after_rows FROM points")
def purge_all(spark, folder):
    store = _database(spark, folder)
    before = store.stored_chunks().count()
    store.purge_all()
    return store.stored_chunks().agg(F.count("*").alias("after_rows")).select(F.lit(before).alias("before_rows"), "after_rows")


_FINAL = "SELECT DISTINCT ON (label_id) * FROM label_metadata ORDER BY label_id, updated_at_unix_secs DESC, crawl_complete DESC"


def _final_labels(spark, folder):
    order = F.struct("updated_at_unix_secs", "crawl_complete")
    rows = table(spark, folder, "label_metadata")
    rest = [c for c in rows.columns if c != "label_id"]
    return rows.groupBy("label_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("label_id", "r.*")


@query(f"SELECT label_id, crawl_complete, updated_at_unix_secs FROM ({_FINAL})")
def label_upsert(spark, folder):
    """In-progress rows first, final ones over them."""
    rows = table(spark, folder, "label_metadata").withColumn("final", F.col("crawl_complete"))
    started, ended = rows.where("not final").drop("final"), rows.where("final").drop("final")
    return membership.upsert(started, ended, "label_id").select("label_id", "crawl_complete", "updated_at_unix_secs")


@query(f"SELECT label_id FROM ({_FINAL}) WHERE label_id <> '{MAIN}'")
def label_delete(spark, folder):
    return _final_labels(spark, folder).where(F.col("label_id") != MAIN).select("label_id")


@query("SELECT DISTINCT relative_path FROM chunks WHERE chunk_kind = 'fallback-split'")
def warning_files(spark, folder):
    return membership.warning_files(table(spark, folder, "chunks"))


_ODD = "SELECT DISTINCT relative_path FROM chunks WHERE chunk_kind <> 'content'"


@query(f"WITH w AS ({_ODD}) SELECT relative_path, (SELECT greatest(count(*) - 20, 0) FROM w) AS more FROM w ORDER BY relative_path LIMIT 20")
def warning_summary(spark, folder):
    return membership.warning_summary(table(spark, folder, "chunks").where("chunk_kind <> 'content'").select("relative_path").distinct())


@query(f"{_ODD} UNION SELECT DISTINCT relative_path FROM incoming_chunks WHERE chunk_kind <> 'content'")
def warnings_next(spark, folder):
    now, prior = (table(spark, folder, t).where("chunk_kind <> 'content'") for t in ("incoming_chunks", "chunks"))
    return membership.warnings_next(now, prior, incremental=True)


# --- working trees: the tracked files are those of the last snapshot but one, what changed since then is dirty


def _tracked(spark, folder):
    clean = clean_entries(table(spark, folder, "file_entries"))
    nos = clean.select("catalog", "snapshot_no").distinct().groupBy("catalog").agg(F.sort_array(F.collect_set("snapshot_no"), asc=False).alias("nos"))
    nos = nos.select("catalog", F.col("nos")[0].alias("last"), F.try_element_at("nos", F.lit(2)).alias("previous"))
    tracked = clean.join(nos, "catalog").where("snapshot_no = previous").select("catalog", "relative_path", "blob")
    now = clean.join(nos, "catalog").where("snapshot_no = last").select("catalog", "relative_path", "blob")
    changes = snapshot_changes(table(spark, folder, "file_entries")).join(nos, "catalog").where("snapshot_no = last").select("catalog", "relative_path", "change")
    return tracked, now, changes


_TRACKED = f"""WITH {CLEAN}, ranked AS (SELECT catalog, snapshot_no, row_number() OVER (PARTITION BY catalog ORDER BY snapshot_no DESC) AS r FROM (SELECT DISTINCT catalog, snapshot_no FROM clean)),
old AS (SELECT c.* FROM clean c JOIN ranked USING (catalog, snapshot_no) WHERE r = 2), now AS (SELECT c.* FROM clean c JOIN ranked USING (catalog, snapshot_no) WHERE r = 1)
"""


def status_line(change, path):
    """A changed path as ``git status`` would list it."""
    return F.concat(F.when(change == "changed", " M ").when(change == "removed", " D ").otherwise("?? "), path)


@query(
    _TRACKED
    + """SELECT coalesce(o.catalog, n.catalog) AS catalog, coalesce(o.path, n.path) AS relative_path, CASE WHEN n.path IS NULL THEN 'deleted' ELSE 'exists' END AS state
  FROM old o FULL JOIN now n ON o.catalog = n.catalog AND o.path = n.path WHERE o.blob IS DISTINCT FROM n.blob"""
)
def dirty_classify(spark, folder):
    _, _, changes = _tracked(spark, folder)
    listed = changes.select("catalog", "relative_path", status_line(F.col("change"), F.col("relative_path")).alias("line"))
    return listed.select("catalog", git.status_path(F.col("line")).alias("relative_path"), git.status_state(F.col("line")).alias("state"))


@query(_TRACKED + "SELECT catalog, path AS relative_path, blob FROM now")
def wt_blob_map(spark, folder):
    """Tracked files, the status list, and fresh ids of the files that the list says exist: the working tree must come out, which none of the three is."""
    tracked, now, changes = _tracked(spark, folder)
    line = status_line(F.col("change"), F.col("relative_path"))
    dirty = changes.select("catalog", git.status_path(line).alias("relative_path"), git.status_state(line).alias("state"))
    keys = ("catalog", "relative_path")
    hashed = now.join(dirty.where("state = 'exists'").select(*keys), [*keys], "left_semi").withColumnRenamed("blob", "blob_id")
    return git.working_tree(tracked.withColumnRenamed("blob", "blob_id"), dirty, hashed, keys).withColumnRenamed("blob_id", "blob")


# --- sizing and embedding


@query(
    """WITH m AS (SELECT s_suppkey, CAST(s_suppkey % 96 + 1 AS BIGINT) * 1073741824 AS ram, CAST(s_nationkey + 1 AS BIGINT) AS cores FROM supplier),
u AS (SELECT *, greatest(0, ram - greatest(4294967296, ram // 4)) AS usable FROM m),
i AS (SELECT *, greatest(1, least(CASE WHEN usable >= 2684354560 THEN usable // 2684354560 ELSE 1 END, least(4, cores))) AS instances FROM u)
SELECT s_suppkey, instances, greatest(1, cores // instances) AS threads, instances * 2684354560 + 536870912 AS estimated FROM i"""
)
def auto_sizing(spark, folder):
    from chunkloom.operators.embedding import auto_sizing as sizing

    machines = table(spark, folder, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 96 + 1).cast("long") * F.lit(1 << 30)).alias("ram"), (F.col("s_nationkey") + 1).cast("long").alias("cores"))
    size = sizing(F.col("ram"), F.col("cores"))
    return machines.select("s_suppkey", size["instances"].alias("instances"), size["threads"].alias("threads"), size["estimated"].alias("estimated"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0")
def utf8_gate(spark, folder):
    """Contents as bytes, every third one broken inside a sign: the broken ones must not pass."""
    whole = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(whole, F.unhex(F.lit("E282")))).otherwise(whole)
    read = git.decoded(table(spark, folder, "documents").select("doc_id", content.alias("content")))
    return read.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT count(*) AS chunks, count(*) FILTER (regexp_matches(text, '\\w')) AS embedded, count(*) FILTER (NOT regexp_matches(text, '\\w')) AS failed FROM (SELECT DISTINCT point_id, text FROM chunks)")
def embed_failures(spark, folder):
    from chunkloom.operators.embedding import hashing_embedder

    embedded = table(spark, folder, "chunks").select("point_id", "text").dropDuplicates(["point_id"]).select(hashing_embedder(64)(F.col("text")).alias("e"))
    return embedded.agg(F.count("*").alias("chunks"), F.count_if(F.col("e.error").isNull()).alias("embedded"), F.count_if(F.col("e.error").isNotNull()).alias("failed"))
