"""The command line: ``python -m chunkloom.cli COMMAND``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.operators import quality, search
from chunkloom.operators.embedding import EMBEDDING_OVERHEAD, PER_INSTANCE_RAM, RESERVE_RAM, hashing_embedder, onnx_embedder
from chunkloom.operators.typescript import Cutter, typescript_chunks
from chunkloom.plans.crawl import crawl
from chunkloom.sources import git
from chunkloom.sources.config import Config, ConfigError, Context, check_catalog, check_label, load_rules, resolve_context, resolve_sizing, tool_home
from chunkloom.sources.warehouse import DatabaseError, Warehouse


def sizing(config: Config) -> tuple[int, int]:
    """Instances of the model and threads of each on this machine; says so if they may need more memory than there is to spare."""
    ram = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    instances, threads = resolve_sizing(config, os.cpu_count() or 1, ram)
    needed = instances * PER_INSTANCE_RAM + EMBEDDING_OVERHEAD
    if needed > ram - max(RESERVE_RAM, ram // 4):
        print(f"warning: {instances} instances of the model may need {needed / (1 << 30):.1f} GB of {ram / (1 << 30):.1f} GB", file=sys.stderr)
    return instances, threads


def session(instances: int | None = None) -> SparkSession:
    """The session that there is, or a new one; on this machine alone it runs as many tasks, each with a model, as there are to be instances."""
    builder = SparkSession.builder.appName("chunkloom").config("spark.ui.showConsoleProgress", "false")
    if instances and not os.environ.get("SPARK_REMOTE") and not os.environ.get("MASTER"):
        builder = builder.master(f"local[{instances}]")
    found = SparkSession.getActiveSession() or builder.getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    return found


def embedder_of(config: Config):
    """The configured model, sized for this machine, or else the deterministic stand-in, each with an id of its own."""
    if config.model_dir:
        _, threads = sizing(config)
        return onnx_embedder(str(config.model_dir), threads=threads), f"onnx:{config.model_dir.name}"
    return hashing_embedder(config.vector_dim), f"hashed-words-{config.vector_dim}:v1"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chunkloom")
    top.add_argument("--config", type=Path, default=None)
    top.add_argument("--debug", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **kwargs):
        return commands.add_parser(name, **kwargs)

    def context(sub) -> None:
        sub.add_argument("--catalog")
        sub.add_argument("--label")

    context(command("use", help="show or set the default catalog and label"))
    command("init-db", help="create the database")
    sub = command("crawl", help="take up a commit or the working tree under a label")
    sub.add_argument("--catalog")
    sub.add_argument("--label", required=True)
    source = sub.add_mutually_exclusive_group(required=True)
    source.add_argument("--commit")
    source.add_argument("--working-dir", action="store_true")
    sub.add_argument("--incremental-warnings", action="store_true")
    sub = command("purge", help="delete a catalog, or everything")
    sub.add_argument("--catalog")
    sub.add_argument("--all", action="store_true")
    sub = command("dump-chunks", help="show how a file would be cut")
    sub.add_argument("--file", type=Path, required=True)
    sub.add_argument("--target-size", type=int, default=6000)
    sub.add_argument("--visualize", action="store_true")
    sub.add_argument("--with-fallback", action="store_true")
    sub = command("search", help="find chunks by meaning")
    sub.add_argument("--text", required=True)
    sub.add_argument("--limit", type=int, default=10)
    context(sub)
    sub = command("view", help="show chunks by file id")
    sub.add_argument("--id", action="append", required=True)
    sub.add_argument("--full-paths", action="store_true")
    sub.add_argument("--chunks-only", action="store_true")
    context(sub)
    sub = command("audit-chunks", help="score how a sample of files is cut")
    sub.add_argument("--count", type=int, default=20)
    sub.add_argument("--dir", required=True)
    return top


def run(args: argparse.Namespace) -> str:
    config = Config.load(args.config or tool_home() / "config.json") if args.command not in ("dump-chunks", "audit-chunks") else Config()
    return globals()["_" + args.command.replace("-", "_")](args, config)


def _use(args, config: Config) -> str:
    if not args.catalog and not args.label:
        found = Context.load()
        return f"{found.catalog}:{found.label}" if found else "no default is set"
    if not (args.catalog and args.label):
        raise ConfigError("give both --catalog and --label, or neither")
    if check_catalog(args.catalog) not in config.catalogs:
        raise ConfigError(f"{args.catalog!r} isn't configured")
    Context(args.catalog, check_label(args.label)).save()
    return f"{args.catalog}:{args.label}"


def _init_db(args, config: Config) -> str:
    if config.database == tool_home() / "default-db":
        tool_home().mkdir(parents=True, exist_ok=True)
    store = Warehouse.create(session(), config.database, vector_dim=config.vector_dim)
    return f"database at {store.path}"


def _crawl(args, config: Config) -> str:
    git.ensure_git()
    where = resolve_context(args.catalog, args.label)
    if where.catalog not in config.catalogs:
        raise ConfigError(f"{where.catalog!r} isn't configured")
    repo = config.catalogs[where.catalog]
    embedder, embedder_id = embedder_of(config)
    store = Warehouse(session(sizing(config)[0] if config.model_dir else None), config.database)
    tell = lambda said: print(said, file=sys.stderr)
    done = crawl(store, repo, where.catalog, where.label, embedder, embedder_id, revision=args.commit, rules=load_rules(repo), incremental_warnings=args.incremental_warnings, progress=tell)
    lines = [f"{done.label_id}: {done.new_files} new files, {done.existing_files} known, {done.chunks} chunks written, {done.failed_chunks} failed, {done.removed_chunks} removed"]
    lines += [f"  warning: {p}" for p in done.warnings[:20]] + ([f"  +{len(done.warnings) - 20} more"] if len(done.warnings) > 20 else [])
    if not done.complete:
        raise RuntimeError("\n".join(lines))
    return "\n".join(lines)


def _purge(args, config: Config) -> str:
    store = Warehouse(session(), config.database)
    if args.all:
        store.purge_all()
        return "everything is deleted"
    if not args.catalog:
        raise ConfigError("give --catalog or --all")
    chunks, labels = store.purge(check_catalog(args.catalog))
    return f"{args.catalog}: {chunks} chunks and {labels} labels deleted"


def _search(args, config: Config) -> str:
    where = resolve_context(args.catalog, args.label)
    spark, (embedder, _) = session(), embedder_of(config)
    wanted = spark.createDataFrame([(args.text,)], "t string").select(embedder(F.col("t")).alias("e")).head().e
    if wanted.vector is None:
        raise RuntimeError(f"the text can't be embedded: {wanted.error}")
    found = search.vector_search(Warehouse(spark, config.database).label_chunks(where.catalog, where.label), list(wanted.vector), None, args.limit)
    line = T.report_line(F.col("breadcrumb"), F.col("split_part_ordinal"), F.col("split_part_count"), F.col("chunk_kind"))
    rows = found.select("file_id", "chunk_ordinal", "distance", line.alias("line"), T.blurb(F.col("text")).alias("blurb")).collect()
    return "\n".join(f"{r.file_id}:{r.chunk_ordinal}  dist={r.distance:.3f}  {r.line}\n{r.blurb}\n" for r in rows)


def _view(args, config: Config) -> str:
    wanted = [search.Selection.parse(x) for x in args.id]
    where = resolve_context(args.catalog, args.label)
    chunks = Warehouse(session(), config.database).label_chunks(where.catalog, where.label)
    line = T.report_line(F.col("breadcrumb"), F.col("split_part_ordinal"), F.col("split_part_count"), F.col("chunk_kind"))
    out = [] if args.chunks_only else [*(f"{name}: {path}" for name, path in sorted({where.catalog: "(not configured)", **config.catalogs}.items())), ""]
    for r in search.view(chunks, wanted).withColumn("line", line).collect():
        if r.point_id is None:
            out.append(f"{args.id[r.request]}: CHUNK NOT FOUND")
            continue
        out += [f"{r.point_id} ({r.chunk_ordinal}/{r.chunk_count})  {r.line}", f"{r.source_uri if args.full_paths else r.relative_path}:{r.start_line}-{r.end_line}"]
        out += ["> " + x for x in r.text.split("\n")] + [""]
    return "\n".join(out)


def _cut_local(paths: list[Path], limit: int, fallback: bool):
    rows = [(str(p), package_of(p), p.read_text(errors="replace")) for p in paths]
    cut = typescript_chunks(session().createDataFrame(rows, "relative_path string, package string, text string"), limit=limit, allow_fallback=fallback)
    return cut.withColumn("crumb", T.breadcrumb(F.col("package"), T.file_name(F.col("relative_path")), F.col("symbol_name")))


def package_of(path: Path) -> str:
    """The name in the nearest manifest above a file; without one, the file's folder."""
    import json

    for folder in path.absolute().parents:
        try:
            name = json.loads((folder / "package.json").read_text()).get("name")
        except (OSError, ValueError, AttributeError):
            continue
        if isinstance(name, str) and name:
            return name
    return str(path.parent)


def _dump_chunks(args, config: Config) -> str:
    chunks = _cut_local([args.file], args.target_size, args.with_fallback)
    out = []
    for i, r in enumerate(chunks.orderBy("start_line").collect(), 1):
        size = len(r.chunk_text.encode())
        out.append(f"chunk {i}: lines {r.start_line}-{r.end_line}, {size} bytes, {r.chunk_type} [{r.chunk_kind}] {r.crumb}" + (" OVERSIZED" if size > args.target_size else " small" if size < 200 else ""))
        lines = r.chunk_text.split("\n")
        out += ["  " + x for x in (lines if args.visualize else lines[:8])] + ([f"  ... ({len(lines) - 8} more lines)"] if len(lines) > 8 and not args.visualize else [])
    if args.debug:
        cutter = Cutter(args.file.read_text(errors="replace"), tsx=args.file.suffix == ".tsx", limit=args.target_size, allow_fallback=args.with_fallback)
        cutter.ranges()
        out += [f"tried {first}-{last}: {kind} at {lines[0]}-{lines[1]}, places {places}" for first, last, kind, lines, places in cutter.trace]
    score = quality.quality_report(chunks, "relative_path", "chunk_text", target=args.target_size).head()
    return "\n".join(out + ([f"quality {score.score:.1f} %, {score.chunks} chunks, {score.small_chunks} small"] if score else ["no chunks"]))


def _audit_chunks(args, config: Config) -> str:
    import random

    found = sorted(p for p in Path(args.dir).rglob("*.ts") if "node_modules" not in p.parts)
    chosen = random.sample(found, min(args.count, len(found)))
    if not chosen:
        return "no files"
    rows = quality.quality_report(_cut_local(chosen, 6000, False), "relative_path", "chunk_text").orderBy("score", "relative_path").collect()
    return "\n".join(f"{r.score:5.1f} %  {r.chunks} chunks ({r.small_chunks} small), {r.min_bytes}-{r.max_bytes} bytes, mean {r.mean_bytes:.0f}  {r.relative_path}" for r in rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args))
    except (ConfigError, DatabaseError, git.GitError, RuntimeError, ValueError) as e:
        if args.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
