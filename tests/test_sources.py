import os

import pytest
from pyspark.sql import functions as F

from readloom.header import parse_bam_header, parse_header
from readloom.operators import index as ops_index
from readloom.operators import sort
from readloom.sources import bam, bgzf, fasta, indexes, records, sam
from tests.samples import HEADER, LINES, write_sam

FIELDS = ["qname", "flag", "ref_id", "pos", "mapq", "cigar", "next_ref_id", "next_pos", "tlen", "seq", "qual", "tags"]


def rows_of(df, *order):
    return [tuple(r[f] for f in FIELDS) for r in df.orderBy(*order).collect()]


def test_bgzf_round_trip_and_damage(tmp_path):
    data = os.urandom(200_000) + b"A" * 300_000
    packed = bgzf.compress(data)
    assert bgzf.decompress(packed) == data and packed.endswith(bgzf.EOF)
    path = tmp_path / "x.gz"
    path.write_bytes(packed)
    with open(path, "rb") as f:
        offsets = bgzf.block_offsets(f, len(packed))
        assert bgzf.has_eof_marker(f, len(packed))
        assert b"".join(d for _, d in bgzf.blocks(f)) == data
        assert all(bgzf.next_block(f, o, len(packed)) == o for o in offsets)
        assert bgzf.next_block(f, offsets[1] + 1, len(packed)) == offsets[2]
    with pytest.raises(ValueError):
        list(bgzf.blocks(open(path, "rb"), 5))
    broken = bytearray(packed)
    broken[100] ^= 255
    with pytest.raises(Exception):
        bgzf.decompress(bytes(broken))


def test_sam_scan_and_sink_round_trip(spark, tmp_path):
    path = write_sam(tmp_path / "a.sam")
    reads = sam.read_sam(spark, path)
    assert reads.count() == len(LINES)
    out = str(tmp_path / "b.sam")
    sam.write_sam(reads.orderBy("rec_no"), out, sam.read_header(path))
    got = open(out).read().splitlines()
    tags = lambda line: sorted(line.split("\t")[11:])
    assert "\n".join(got[: HEADER.count("\n")]) + "\n" == HEADER
    for a, b in zip(got[HEADER.count("\n") :], LINES, strict=True):
        assert a.split("\t")[:11] == b.split("\t")[:11] and tags(a) == tags(b)


@pytest.mark.parametrize(
    "line",
    ["too\tfew", LINES[0].replace("chr1", "chr9"), LINES[0].replace("10M", "9M"), LINES[0].replace("10M", "10Q"), LINES[0].replace("IIIIIIIIII", "III"), LINES[0].replace("zm:i:1", "zm:i:x"), LINES[0].replace("\t60\t", "\t300\t")],
)
def test_sam_rejects_malformed_lines(spark, tmp_path, line):
    path = tmp_path / "bad.sam"
    path.write_text(HEADER + line + "\n")
    with pytest.raises(Exception):
        sam.read_sam(spark, str(path)).collect()
    path.write_text(HEADER + "\n".join([LINES[1], line, LINES[2]]) + "\n")
    assert [r["qname"] for r in sam.read_sam(spark, str(path), mode="DROPMALFORMED").orderBy("rec_no").collect()] == ["m/1/10_20", "m/2/0_12"]


def test_bam_round_trip_in_small_splits(spark, tmp_path):
    sam_path = write_sam(tmp_path / "a.sam")
    reads, header = sam.read_sam(spark, sam_path), sam.read_header(sam_path)
    many = reads.crossJoin(spark.range(3000)).withColumn("qname", F.concat("qname", F.lit("x"), F.col("id"))).drop("id")
    path = str(tmp_path / "a.bam")
    bam.write_bam(many.repartition(3).sortWithinPartitions("qname"), path, header)
    assert parse_bam_header(bgzf.decompress(open(path, "rb").read()))[0].to_text() == header.to_text()
    for split in (3000, 20_000, 1 << 30):
        back = bam.read_bam(spark, path, split_bytes=split)
        assert back.count() == many.count()
        keys = ["qname", "flag", "pos"]
        assert rows_of(back.where(F.col("qname").endswith("x7")), *keys) == rows_of(many.where(F.col("qname").endswith("x7")), *keys)
    numbered = bam.numbered(bam.read_bam(spark, path, split_bytes=3000), span=1 << 28)
    assert [r[0] for r in numbered.orderBy("voffset").select("rec_no").collect()] == list(range(many.count()))
    plain = rows_of(bam.read_binary(spark, path).where(F.col("qname").endswith("x7")), "qname", "flag", "pos")
    assert plain == rows_of(many.where(F.col("qname").endswith("x7")), "qname", "flag", "pos")


def test_bam_tag_options_and_columns(spark, tmp_path):
    sam_path = write_sam(tmp_path / "a.sam")
    path = str(tmp_path / "a.bam")
    bam.write_bam(sam.read_sam(spark, sam_path), path, sam.read_header(sam_path))
    kept = bam.read_bam(spark, path, keep_tags="zm,RG").select(F.explode("tags").alias("k", "v")).select("k").distinct()
    assert {r["k"] for r in kept.collect()} == {"zm", "RG"}
    few = bam.read_bam(spark, path, columns="qname,pos", drop_tags="zm").first()
    assert few["seq"] is None and few["qname"]


def test_bam_split_by_tag(spark, tmp_path):
    sam_path = write_sam(tmp_path / "a.sam")
    bam.write_bam(sam.read_sam(spark, sam_path).repartition(3), str(tmp_path / "out"), sam.read_header(sam_path), split_tag="zm")
    assert sorted(os.listdir(tmp_path / "out")) == ["1.bam", "2.bam", "4.bam", "5.bam", "none.bam"]
    assert [bam.read_bam(spark, str(tmp_path / "out" / f"{k}.bam")).count() for k in ("1", "none")] == [2, 2]
    assert bam.read_bam(spark, str(tmp_path / "out" / "*.bam")).count() == len(LINES)


def test_ensure_index(spark, tmp_path):
    sam_path = write_sam(tmp_path / "a.sam")
    path = str(tmp_path / "a.bam")
    bam.write_bam(sort.sort_coordinate(sam.read_sam(spark, sam_path)), path, sam.read_header(sam_path))
    index = indexes.ensure_bam_index(spark, path)
    before = os.stat(index).st_mtime_ns
    assert indexes.ensure_bam_index(spark, path) == index and os.stat(index).st_mtime_ns == before


def test_long_cigar_and_tag_encodings():
    row = {"qname": "r", "flag": 0, "ref_id": 0, "pos": 5, "mapq": 9, "next_ref_id": -1, "next_pos": -1, "tlen": 0, "qual": None}
    cigar = [{"op": "M", "len": 1}, {"op": "I", "len": 1}] * 40_000
    row |= {"cigar": cigar, "seq": "AC" * 40_000, "tags": {"XX": records.tag("i", i=70_000), "YY": records.tag("B", et="c", ai=[-1, 2])}}
    data = records.encode_record(row)
    back = records.decode_record(data, 4, len(data) - 4, lambda i: "chr1")
    assert back["cigar"] == cigar and back["tags"] == row["tags"] and back["qual"] is None
    assert [records.int_code(x) for x in (0, 255, -1, 256, -129, 70_000, -40_000)] == ["C", "C", "c", "S", "s", "I", "i"]


def test_bai_build_query_and_pushdown(spark, tmp_path):
    header = parse_header("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:9000000\n@SQ\tSN:chr2\tLN:9000000\n")
    base = sam.parse_lines(spark.createDataFrame([(LINES[0], 0)], "value string, seq_no bigint"), header)
    n = 30_000
    many = base.crossJoin(spark.range(n)).withColumns(
        {"pos": ((F.col("id") % (n // 2)) * 500).cast("int"), "ref_id": F.expr(f"cast(id div {n // 2} as int)"), "qname": F.concat(F.lit("q"), F.col("id"))}
    )
    path = str(tmp_path / "s.bam")
    bam.write_bam(sort.sort_coordinate(many.drop("id")), path, header)
    indexes.build_bam_index(spark, path)
    bai = indexes.read_bai(path + ".bai")
    assert bai.counts() == (n, 0, 0)
    indexes.write_bai(bai, str(tmp_path / "again.bai"))
    assert open(tmp_path / "again.bai", "rb").read() == open(path + ".bai", "rb").read()
    region = (F.col("ref_id") == 1) & (F.col("pos") < 50_000)
    got = bam.read_bam(spark, path).where(region)
    assert got.count() == 100
    chunks = bai.chunks(1, 0, 50_000)
    assert chunks and sum(e - b for b, e in chunks) < (os.path.getsize(path) << 16) / 3
    assert ops_index.no_coordinate_count(got).first()[0] == 0


def test_zmi_pbi_crai(spark, tmp_path):
    rows = [(7, 10, 100, -1, -1), (7, 10, 200, 3, 4), (8, 11, 300, 65535, 0)]
    path = str(tmp_path / "x.bam.zmi")
    assert indexes.write_zmi(rows, path) == 3
    got = indexes.read_zmi(path)
    assert list(got[["rg_id", "zmw", "voffset", "fwd", "rev"]].itertuples(index=False, name=None)) == rows
    assert [r["zmw"] for r in indexes.zmw_index(spark, str(tmp_path / "x.bam")).orderBy("rec_no").collect()] == [10, 10, 11]
    with pytest.raises(ValueError):
        indexes.write_zmi([(1, 1, 1, 70_000, 0)], path)
    pbi = str(tmp_path / "y.bam.pbi")
    indexes.write_pbi([(1, 5, 25, 3, 0.5, 0, 77), (1, 0, 9, 4, 0.5, 0, 99)], pbi)
    assert list(indexes.read_pbi(pbi)["qlen"]) == [20, 9]
    crai = [(0, 1, 50, 26, 300, 900), (-1, 0, 0, 1226, 200, 100)]
    indexes.write_crai(crai, str(tmp_path / "z.crai"))
    assert indexes.read_crai(str(tmp_path / "z.crai")) == crai
    with pytest.raises(FileNotFoundError):
        indexes.zmw_index(spark, str(tmp_path / "none.bam"))


def test_zmi_from_bam(spark, tmp_path):
    sam_path = write_sam(tmp_path / "a.sam")
    path = str(tmp_path / "a.bam")
    bam.write_bam(sam.read_sam(spark, sam_path).coalesce(1), path, sam.read_header(sam_path))
    indexes.build_zmi(spark, path)
    got = indexes.read_zmi(path + ".zmi")
    assert list(got["zmw"]) == [1, 1, 2, 3, 3, 4, 5]
    assert list(got["rg_id"])[0] == 0xA1B2C3D4 - 2**32 and list(got["fwd"])[1] == 3


def test_fasta(spark, tmp_path):
    path = tmp_path / "r.fa"
    path.write_text(">chr1 text\nACGTA\nCGTac\nGG\n>odd\nACG\nACGTT\nA\n>empty\n")
    fa = fasta.Fasta(str(path))
    assert fa.fetch("chr1", 3, 8) == "TACGT" and fa.fetch("chr1", 9, 99) == "CGG"
    assert fa.fetch("odd", 1, 8) == "CGACGTT" and fa.fetch("empty", 0, 5) == ""
    fasta.write_fai(str(path))
    assert fasta.read_fai(str(path) + ".fai")[0].length == 12
    bam.register(spark)
    os.remove(str(path) + ".fai")
    got = spark.read.format("fasta").option("window", 5).load(str(path)).where("name = 'chr1'").orderBy("start").collect()
    assert [r["seq"] for r in got] == ["ACGTA", "CGTAC", "GG"]


def test_tasks_join_parts_and_decode_indexes(spark, tmp_path, monkeypatch):
    """With small copies and stretches every file takes the way of a large one."""
    from pyspark.sql import functions as F

    from readloom.sources import bgzf, cram, parts

    header = sam.read_header(write_sam(tmp_path / "a.sam"))
    reads = sam.read_sam(spark, str(tmp_path / "a.sam")).repartitionByRange(3, "rec_no").sortWithinPartitions("rec_no")
    written = {}
    for size in (64 << 20, 100):
        monkeypatch.setattr(parts, "COPY_BYTES", size)
        bam.write_bam(reads, f"{tmp_path}/{size}.bam", header)
        cram.write_cram(reads, f"{tmp_path}/{size}.cram", header, slice_records=2, crai="true")
        sam.write_sam(reads, f"{tmp_path}/{size}.sam", header)
        bam.write_bam(reads, f"{tmp_path}/{size}-split", header, split_tag="zm")
        names = [f"{size}.bam", f"{size}.cram", f"{size}.cram.crai", f"{size}.sam", *(f"{size}-split/{n}" for n in sorted(os.listdir(f"{tmp_path}/{size}-split")))]
        written[size] = [(tmp_path / n).read_bytes() for n in names]
    assert written[64 << 20] == written[100]
    assert not [n for n in os.listdir(tmp_path) if ".parts-" in n or ".tmp-" in n]
    assert cram.read_cram(spark, f"{tmp_path}/100.cram").count() == 7

    rows = spark.range(30_000).select((F.col("id") % 7).cast("int").alias("rg_id"), F.col("id").cast("int").alias("zmw"), (F.col("id") * 64).alias("voffset"), (F.col("id") % 9 - 1).cast("int").alias("fwd"), F.lit(2).alias("rev"))
    path = f"{tmp_path}/big.bam.zmi"
    assert indexes.write_zmi_frame(rows, path) == 30_000
    want = indexes.read_zmi(path)
    assert want["zmw"].tolist() == list(range(30_000)) and bgzf.has_eof_marker(open(path, "rb"), os.path.getsize(path))
    pbi = f"{tmp_path}/other.bam.pbi"
    indexes.write_pbi([(i % 5, i, i + 3 + i % 4, i * 2, 0.5, 0, i * 8) for i in range(30_000)], pbi)
    monkeypatch.setattr(indexes, "INDEX_ENTRIES", 7001)
    for base, frame in (("big", want), ("other", indexes.read_pbi(pbi))):
        got = indexes.zmw_index(spark, f"{tmp_path}/{base}.bam").orderBy("rec_no").toPandas()
        for name in ("rec_no", "rg_id", "zmw", "voffset", *(["fwd", "rev"] if base == "big" else ["qlen"])):
            assert got[name].tolist() == frame[name].tolist(), name
    with pytest.raises(Exception, match="barcodes"):
        indexes.write_zmi_frame(rows.withColumn("fwd", F.lit(70_000)), path)
