"""Command line: python -m readloom TOOL ...; exit status 0 or 1."""

from __future__ import annotations

import argparse
import hashlib
import os
import shutil
import stat
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import header as H
from readloom.functions import hashing
from readloom.functions.storage import checkpoint_dir
from readloom.functions.tags import strip_kinetics
from readloom.header import PROGRAM, Header
from readloom.operators import depth as depth_ops
from readloom.operators import lossless, region, sample, sort, zmw
from readloom.sources import bam, bgzf, cram, indexes, sam
from readloom.sources.fasta import Fasta
from readloom.streaming.status import StatusLines, measured


def session() -> SparkSession:
    builder = SparkSession.builder.appName(PROGRAM).config("spark.ui.showConsoleProgress", "false")
    if not os.environ.get("SPARK_MASTER") and not SparkSession.getActiveSession():
        builder = builder.master("local[*]")
    return builder.getOrCreate()


def kind(path: str) -> str:
    """Format by extension: sam, cram, else bam."""
    suffix = os.path.splitext(path)[1].lower()
    return suffix[1:] if suffix in (".sam", ".cram") else "bam"


def header_of(path: str) -> Header:
    return {"sam": sam.read_header, "cram": cram.read_header, "bam": lambda p: bam.read_header(p)[0]}[kind(path)](path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads of a file with rec_no in file order."""
    if kind(path) == "sam":
        return sam.read_sam(spark, path)
    if kind(path) == "cram":
        return cram.read_cram(spark, path, **options)
    return bam.numbered(bam.read_bam(spark, path, **options))


def command_line(args: argparse.Namespace) -> str:
    return f"{PROGRAM} {args.tool} " + " ".join(map(str, args.raw))


def show(reads: DataFrame, header: Header | None) -> None:
    if header is not None:
        sys.stdout.write(header.to_text())
    for row in sam.sam_lines(reads).orderBy("file_ord", "rec_no").select("line").toLocalIterator():
        sys.stdout.write(row["line"] + "\n")


def ref_frame(spark: SparkSession, header: Header) -> DataFrame:
    return H.references_frame(spark, header)


def find_region(header: Header, text: str) -> region.Region:
    found = region.parse_region(text)
    if found.name is not None and header.reference_id(found.name) < 0:
        raise ValueError(f"unknown reference {found.name}")
    return found


# --- tools ---------------------------------------------------------------------------------


def dump(args) -> None:
    header = header_of(args.input)
    if args.no_header and args.header_only:
        raise ValueError("--no-header and --header-only exclude each other")
    if (args.region or args.index) and kind(args.input) != "cram":
        raise ValueError("--region and --index need a CRAM file")
    if args.index and not args.region:
        raise ValueError("--index needs --region")
    if args.header_only:
        sys.stdout.write(header.to_text())
        return
    spark = session()
    options = {"reference": args.reference} if args.reference and kind(args.input) == "cram" else {}
    reads = load(spark, args.input, **options)
    if args.region:
        if args.index:
            slices = indexes.read_crai(args.index)
            reads = reads.where(F.col("ref_id").isin([s[0] for s in slices]))
        reads = region.query_region(reads, ref_frame(spark, header), find_region(header, args.region), nonempty=True)
    show(reads, None if args.no_header else header)


def convert(args) -> None:
    header, spark = header_of(args.input), session()
    H.add_program(header, f"{PROGRAM}.convert", command_line(args))
    reads = load(spark, args.input).orderBy("file_ord", "rec_no")
    if kind(args.output) == "cram":
        options = {"slice_records": args.records_per_slice, "slice_bases": args.bases_per_slice or 2**62, "crai": str(args.write_crai).lower()}
        if args.methods:
            options["methods"] = args.methods
        if args.reference:
            options["reference"] = args.reference
            add_checksums(header, args.reference)
        cram.write_cram(reads, args.output, header, **options)
    else:
        write(reads, args.output, header)


def add_checksums(header: Header, reference: str) -> None:
    """M5 of each reference: the MD5 of its bases in upper case."""
    fasta = Fasta(reference)
    if not fasta.sequences:
        raise ValueError(f"no sequences in {reference}")
    for r in header.references:
        digest = hashlib.md5()
        for at in range(0, r.length, 1 << 20):
            digest.update(fasta.fetch(r.key, at, at + (1 << 20)).encode())
        r.tags["M5"] = digest.hexdigest()


def write(reads: DataFrame, path: str, header: Header, compression: int = 6) -> None:
    if kind(path) == "sam":
        sam.write_sam(reads, path, header)
    elif kind(path) == "cram":
        cram.write_cram(reads, path, header)
    else:
        bam.write_bam(reads, path, header, compression)


def sort_(args) -> None:
    header, spark = header_of(args.input), session()
    reads = load(spark, args.input)
    if args.order == "tag":
        if not args.tag:
            raise ValueError("--order tag needs --tag")
        number, text = sort.tag_columns(args.tag)
        ordered = sort.sort_tag(reads, number, text)
    elif args.minimise:
        if args.order != "coordinate":
            raise ValueError("minimisers go with coordinate order")
        ordered = sort.sort_minimiser(reads)
    else:
        ordered = {"coordinate": sort.sort_coordinate, "queryname": sort.sort_queryname}[args.order](reads)
    out = H.sorted_header(header, args.order, args.minimise)
    H.add_program(out, f"{PROGRAM}.sort", command_line(args))
    write(ordered, args.output, out, args.compression)


def merge(args) -> None:
    headers, spark = [header_of(p) for p in args.inputs], session()
    orders = [h.sort_order for h in headers]
    mode = args.order or sort.merge_mode(orders, args.concat)
    out = H.merge_union(headers)
    if mode != "concat" and args.order:
        sort.check_merge_order(orders, mode)
    if args.bai and (args.concat or mode != "coordinate"):
        raise ValueError("--bai needs a merge by coordinate")
    inputs = [load(spark, p) for p in args.inputs]
    with StatusLines(args.status_json or os.devnull, "merge", inputs=args.inputs) as status:
        status.phase("plan")
        how = "sort"
        if mode == "concat" or args.concat:
            rows, how = sort.concat(inputs).orderBy("file_ord", "rec_no"), "concat"
            out.hd["SO"] = "unsorted"
        else:
            rows = None
            if mode == "coordinate" and not args.no_passthrough and {kind(p) for p in args.inputs} == {"bam"} and len({tuple(r.key for r in h.references) for h in headers}) == 1:
                rows = sort.merge_chain([bam.read_bam(spark, p) for p in args.inputs])
                how = "sort" if rows is None else "passthrough"
            if rows is None:
                rows = sort.merge(inputs, mode, *(sort.tag_columns(args.tag) if mode == "tag" else ()))
            out = H.sorted_header(out, mode)
        H.add_program(out, f"{PROGRAM}.merge", command_line(args))
        status.phase("write", mode=how)
        began = time.perf_counter()
        rows, written = measured(rows)
        write(rows, args.output, out, args.compression)
        seconds = time.perf_counter() - began
        status.final(mode=how, inputs=len(inputs), input_bytes=sum(map(os.path.getsize, args.inputs)), output_bytes=os.path.getsize(args.output), seconds=round(seconds, 3), **written.get)
    if args.bai:
        indexes.build_bam_index(spark, args.output)


def subsample(args) -> None:
    if (args.fraction is None) == (args.yield_ is None):
        raise ValueError("give either --fraction or --yield")
    header, spark = header_of(args.input), session()
    seed = hashing.fnv1a(header.to_text().encode()) if args.seed == "auto" else int(args.seed)
    if not 0 <= seed < 2**32:
        raise ValueError(f"seed out of range: {args.seed}")
    reads = load(spark, args.input)
    if args.fraction is not None:
        kept, note = sample.fraction_sample(reads, args.fraction, seed), f"fraction={args.fraction:g}"
    else:
        identity = indexes.zmi_columns(reads).select("file_ord", "voffset", "rg_id", "zmw")
        coded = reads.join(identity, ["file_ord", "voffset"]).withColumn("qlen", F.length("seq"))
        kept, note = sample.yield_sample(coded, sample.parse_yield(args.yield_), seed), f"yield={args.yield_}"
    if args.strip_kinetics:
        kept = kept.withColumn("tags", strip_kinetics(F.col("tags")))
    header.comments.append(f"Sub-sampled {note} seed={seed}")
    H.add_program(header, f"{PROGRAM}.subsample", command_line(args))
    with StatusLines(args.status_json or os.devnull, "subsample", input=args.input) as status:
        status.phase("write")
        write(kept.orderBy("file_ord", "rec_no"), args.output, header, args.compression)
        counts = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("b")).first()
        status.final(kept_records=counts["n"], kept_bases=counts["b"])


def shortest(x: float) -> str:
    """The shortest text that reads back as x, whole numbers without a point."""
    return str(int(x)) if x == int(x) else repr(x)


def depth(args) -> None:
    if args.bin_size < 1:
        raise ValueError("--bin-size must be at least 1")
    header, spark = header_of(args.input), session()
    reads, refs = load(spark, args.input), ref_frame(spark, header)
    with StatusLines(args.status_json or os.devnull, "depth", input=args.input) as status:
        status.phase("count")
        bins = depth_ops.binned_depth(reads, refs, args.bin_size).orderBy("ref_id", "start")
        with open(args.output + ".tmp", "w", encoding="utf-8") as f:
            f.write("#contig\tstart\tend\tmean_depth\n")
            for r in bins.toLocalIterator():
                f.write(f"{r['contig']}\t{r['start']}\t{r['end']}\t{shortest(r['mean_depth'])}\n")
        os.replace(args.output + ".tmp", args.output)
        status.final(**depth_ops.depth_totals(reads, refs, args.bin_size).first().asDict())


def undo(args) -> None:
    header, spark = header_of(args.input), session()
    rows = lossless.restore_reads(load(spark, args.input)).orderBy("file_ord", "rec_no")
    write(rows, args.output, H.undone_header(header, command_line(args)))


def bai_build(args) -> None:
    print(indexes.build_bam_index(session(), args.input))


def bai_query(args) -> None:
    header, spark = header_of(args.input), session()
    if not os.path.exists(args.input + ".bai"):
        raise FileNotFoundError(f"no index {args.input}.bai")
    reads = bam.read_bam(spark, args.input).withColumn("rec_no", F.col("voffset"))
    show(region.query_region(reads, ref_frame(spark, header), find_region(header, args.region)), header)


def zmi_build(args) -> None:
    shutil.copyfile(args.input, args.output + ".tmp")
    os.replace(args.output + ".tmp", args.output)
    indexes.build_zmi(session(), args.output)


def zmi_index(args) -> None:
    path = indexes.build_zmi(session(), args.input)
    if not args.quiet:
        print(path)


def zmi_query(args) -> None:
    spark, header = session(), header_of(args.input)
    places = zmw.zmw_point(indexes.zmw_index(spark, args.input), args.zmw).select("voffset")
    reads = bam.read_bam(spark, args.input).join(F.broadcast(places), "voffset", "left_semi")
    show(reads.withColumn("rec_no", F.col("voffset")), header)


def chunk(args) -> None:
    spark, header = session(), header_of(args.input)
    number, _, total = args.chunk.partition("/")
    index = indexes.zmw_index(spark, args.input)
    if args.mode != "scatter" and (args.tile is not None or args.seed is not None):
        raise ValueError("--tile and --seed need --mode scatter")
    if args.mode == "scatter":
        places = zmw.scatter_chunk(index, int(number), int(total), args.tile or 1, args.seed or 0)
    else:
        places = zmw.contiguous_chunk(index, int(number), int(total))
    reads = bam.read_bam(spark, args.input).join(places.select("voffset"), "voffset", "left_semi")
    show(reads.withColumn("rec_no", F.col("voffset")), header)


def bench(args) -> None:
    """Records and megabytes a second of the scans of one BAM file."""
    spark = session()

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        n = run()
        took = time.perf_counter() - began
        print(f"{name}\t{n}\t{took:.3f} s\t{n / took:.0f} records/s\t{os.path.getsize(args.input) / took / 1e6:.1f} MB/s")

    def blocks() -> int:
        with open(args.input, "rb") as f:
            return sum(1 for _ in bgzf.blocks(f))

    timed("blocks", blocks)
    timed("header", lambda: len(bam.read_header(args.input)[0].references))
    timed("scan", lambda: bam.read_bam(spark, args.input, columns="voffset").count())
    timed("fields", lambda: bam.read_bam(spark, args.input, columns="voffset,qname,flag,ref_id,pos", keep_tags="zm").count())
    timed("decoded", lambda: bam.read_bam(spark, args.input).count())
    timed("text", lambda: sam.sam_lines(bam.read_bam(spark, args.input)).agg(F.count("line")).first()[0])
    timed("sort", lambda: sort.sort_coordinate(bam.read_bam(spark, args.input, columns="voffset,flag,ref_id,pos")).count())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=PROGRAM)
    tools = p.add_subparsers(dest="tool")

    def tool(name: str, run, *positional: str) -> argparse.ArgumentParser:
        t = tools.add_parser(name)
        t.set_defaults(run=run)
        for x in positional:
            t.add_argument(x)
        return t

    t = tool("dump", dump, "input")
    t.add_argument("--reference")
    t.add_argument("--region")
    t.add_argument("--index")
    t.add_argument("--no-header", action="store_true")
    t.add_argument("--header-only", action="store_true")
    t = tool("convert", convert, "input", "output")
    t.add_argument("--reference")
    t.add_argument("--records-per-slice", type=int, default=cram.SLICE_RECORDS)
    t.add_argument("--bases-per-slice", type=int, default=cram.SLICE_BASES)
    t.add_argument("--write-crai", action="store_true")
    t.add_argument("--methods", help="numbers of the CRAM block methods to try, such as 1,5")
    t = tool("sort", sort_, "input", "output")
    t.add_argument("--order", choices=("coordinate", "queryname", "tag"), default="coordinate")
    t.add_argument("--tag")
    t.add_argument("--minimise", action="store_true")
    t.add_argument("--memory", type=sample.parse_memory, help="taken for granted: Spark spills by itself")
    t.add_argument("--compression", type=int, default=6)
    t = tool("merge", merge, "output")
    t.add_argument("inputs", nargs="+")
    t.add_argument("--order", choices=("coordinate", "queryname", "tag"))
    t.add_argument("--tag")
    t.add_argument("--concat", action="store_true")
    t.add_argument("--bai", action="store_true")
    t.add_argument("--no-passthrough", action="store_true", help="sort even if the inputs follow each other")
    t.add_argument("--status-json", help="report of the run as JSON lines")
    t.add_argument("--compression", type=int, default=6)
    t = tool("subsample", subsample, "input", "output")
    t.add_argument("--fraction", type=float)
    t.add_argument("--yield", dest="yield_")
    t.add_argument("--seed", default="0")
    t.add_argument("--strip-kinetics", action="store_true")
    t.add_argument("--status-json")
    t.add_argument("--compression", type=int, default=6)
    t = tool("depth", depth, "input", "output")
    t.add_argument("--bin-size", type=int, default=depth_ops.BIN_SIZE)
    t.add_argument("--status-json")
    tool("undo", undo, "input", "output")
    tool("bai-build", bai_build, "input")
    tool("bai-query", bai_query, "input", "region")
    tool("zmi-build", zmi_build, "input", "output")
    tool("zmi-index", zmi_index, "input").add_argument("--quiet", action="store_true")
    tool("zmi-query", zmi_query, "input").add_argument("zmw", type=int)
    t = tool("chunk", chunk, "input", "chunk")
    t.add_argument("--mode", choices=("contiguous", "scatter"), default="contiguous")
    t.add_argument("--tile", type=int)
    t.add_argument("--seed", type=int)
    tool("bench", bench, "input")
    return p


def seekable(path: str) -> str:
    """A file with the content of path: a stream (- or a named pipe) is copied, and named for the format that it begins with."""
    if path != "-" and not (os.path.exists(path) and stat.S_ISFIFO(os.stat(path).st_mode)):
        return path
    base = checkpoint_dir(session()).removeprefix("file://").removeprefix("file:")
    copy = f"{base}/readloom-stream-{uuid.uuid4().hex}"
    with open(copy, "wb") as out:
        if path == "-":
            shutil.copyfileobj(sys.stdin.buffer, out, 1 << 20)
        else:
            with open(path, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
    with open(copy, "rb") as f:
        head = f.read(4)
    named = copy + (".cram" if head == b"CRAM" else ".bam" if head[:2] == b"\x1f\x8b" else ".sam")
    os.replace(copy, named)
    return named


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p = parser()
    if not argv:
        p.print_help()
        return 0
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    args.raw = argv[1:]
    try:
        if "input" in args:
            args.input = seekable(args.input)
        if "inputs" in args:
            args.inputs = [seekable(p) for p in args.inputs]
        args.run(args)
    except (ValueError, OSError, KeyError, NotImplementedError) as e:
        print(f"{PROGRAM} {args.tool}: {e}", file=sys.stderr)
        return 1
    return 0
