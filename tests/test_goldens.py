"""Results that are known from outside: published examples and the reference's stated values."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.cli import main
from readloom.functions import cigar as C
from readloom.functions import hashing as H
from readloom.functions import names as N
from readloom.functions.cigar import bin_of, bins_of, parse_cigar
from readloom.header import Header, add_program, collection_union, merge_union, parse_header, undone_header
from readloom.operators import depth, index, region, sample, sort, zmw
from readloom.sources import sam


def test_depth_of_eight_records(spark, tmp_path):
    path = tmp_path / "cases.sam"
    rows = [("r1", 0, "chr1", 1, "5M2D3M"), ("r3", 1024, "chr1", 1, "10M"), ("r4", 512, "chr1", 1, "10M"), ("r5", 256, "chr1", 1, "10M")]
    rows += [("r2", 16, "chr1", 4, "2S3=1X2N4M"), ("r6", 2048, "chr1", 20, "8M3I3M"), ("r8", 0, "chr2", 1, "4M1D2M"), ("r7", 4, "chr2", 5, "*")]
    head = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:30\n@SQ\tSN:chr2\tLN:12\n@SQ\tSN:chr3\tLN:5\n"
    path.write_text(head + "".join(f"{n}\t{f}\t{r}\t{p}\t60\t{c}\t*\t0\t0\t*\t*\n" for n, f, r, p, c in rows))
    assert main(["depth", "--bin-size", "4", str(path), str(tmp_path / "d.tsv")]) == 0
    got = [tuple(x.split("\t")) for x in (tmp_path / "d.tsv").read_text().splitlines()[1:]]
    means = {"chr1": ["1.25", "1.75", "1.25", "0.25", "0.25", "1", "1", "1"], "chr2": ["1", "0.75", "0"], "chr3": ["0", "0"]}
    lengths = {"chr1": 30, "chr2": 12, "chr3": 5}
    assert got == [(c, str(4 * i), str(min(4 * i + 4, lengths[c])), m) for c, ms in means.items() for i, m in enumerate(ms)]
    header = sam.read_header(str(path))
    refs = spark.createDataFrame([(i, r.key, r.length) for i, r in enumerate(header.references)], "ref_id int, name string, length int")
    totals = depth.depth_totals(sam.read_sam(spark, str(path)), refs, 4).first()
    assert tuple(totals) == (8, 4, 36, 13, 4)


@pytest.mark.parametrize(("fraction", "kept"), [(0.1, 993), (0.5, 5032)])
def test_fraction_of_ten_thousand_names(spark, fraction, kept):
    names = spark.range(10_000).select(F.format_string("read%05d", "id").alias("qname"))
    assert sample.fraction_sample(names, fraction).count() == kept
    cut = H.fraction_cutoff(fraction)
    assert sum(H.wang_py(H.x31_py(f"read{i:05d}")) % H.BUCKETS < cut for i in range(10_000)) == kept


def molecules():
    """The identities and lengths of the 302 reads of the reference's test recipe (seed 7)."""
    rng, out = random.Random(7), []
    for i, hole in enumerate(sorted(rng.sample(range(1, 50_000_000), 300))):
        for _ in range(2 if i in (10, 200) else 1):
            n = rng.randint(200, 2000)
            for _ in range(n):
                rng.choice("ACGT")
            for _ in range(n):
                rng.randint(20, 40)
            out.append((hole, n))
    return out


def test_yield_of_the_molecules(spark):
    rg = N.read_group_number_py("a1b2c3d4")
    reads = spark.createDataFrame([(rg, z, n) for z, n in molecules()], "rg_id int, zmw int, qlen int")
    assert reads.agg(F.count("*"), F.sum("qlen")).first()[:] == (302, 321748)
    for text, records, bases in (("100K", 91, 100536), ("0.05m", 46, 51621), ("50K", 46, 51621)):
        got = sample.yield_sample(reads, sample.parse_yield(text), seed=5)
        assert got.agg(F.count("*"), F.sum("qlen")).first()[:] == (records, bases)
    split = {r["zmw"] for r in sample.yield_sample(reads, 160_000, seed=1).groupBy("zmw").count().where("count > 1").collect()}
    assert split == {2631155, 33131177}
    row = reads.select("zmw", sample.zmw_bucket(F.col("rg_id"), F.col("zmw"), 5).alias("b")).collect()
    assert all(r["b"] == sample.zmw_bucket_py(rg, r["zmw"], 5) for r in row)


def test_scatter_takes_all_molecules_of_the_reads(spark, tmp_path):
    from readloom import queries
    from readloom.plans import driver_tables as D

    line = spark.range(1500).select(
        *(F.lit(1).cast("bigint").alias(c) if c != "l_orderkey" else (F.col("id") % 1000).alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        *(F.lit(1.0).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
        *(F.lit("R").alias(c) for c in ("l_returnflag", "l_linestatus")),
        F.lit("2024-01-01").cast("timestamp").alias("l_shipdate"),
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    order, stream = list(range(334)), H.SplitMix(7)  # tiles of three of a thousand molecules
    stream.next()
    for i in range(333, 0, -1):
        j = stream.next() % (i + 1)
        order[i], order[j] = order[j], order[i]
    tiles = set(order[334 // 4 : 334 // 2])
    seen = {}
    reads = sorted((r["rec_no"], r["zmw"]) for r in D.reads(spark, str(tmp_path)).collect())
    want = [(n, seen.setdefault(z, len(seen))) for n, z in reads]
    got = sorted((r["rec_no"], r["zmw_no"]) for r in queries.queries()["chunk_scatter_reads"](spark, str(tmp_path)).collect())
    assert len(seen) == 1000 and got == [(n, z) for n, z in want if z // 3 in tiles]


def test_chunks_of_twelve_molecules(spark):
    rows = spark.range(12).select(F.col("id").alias("rec_no"), F.lit(0).alias("rg_id"), F.col("id").cast("int").alias("zmw"))

    def holes(df):
        return sorted(r["zmw"] for r in df.collect())

    assert holes(zmw.contiguous_chunk(rows, 1, 4)) == [0, 1, 2]
    assert holes(zmw.scatter_chunk(rows, 1, 4, 1, 7)) == [2, 4, 9]
    assert holes(zmw.scatter_chunk(rows, 4, 4, 3, 7)) == [0, 1, 2]
    assert sorted(sum((holes(zmw.scatter_chunk(rows, k, 4, 1, 7)) for k in range(1, 5)), [])) == list(range(12))
    for bad in ((0, 4), (5, 4), (1, 0)):
        with pytest.raises(ValueError):
            zmw.contiguous_chunk(rows, *bad)


def test_seed_scramble_is_the_c_librarys():
    # First numbers of srand(1), srand(42) and srand(2**31 + 5) of the GNU C library.
    import ctypes

    libc = ctypes.CDLL(None)
    for seed in (1, 42, 5, 123456789, 2**31 - 1, 2**31 + 5, 2**32 - 1):
        libc.srand(ctypes.c_uint(seed))
        assert H.scrambled_seed(seed) == libc.rand()
    assert H.scrambled_seed(0) == 0


def test_64_bit_products(spark):
    rng = random.Random(1)
    xs = [0, 1, -1, 2**63 - 1, -(2**63), *(H.signed64(rng.getrandbits(64)) for _ in range(200))]
    got = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", H.multiply64(F.col("x"), H.MIX_A).alias("p"), H.mix64(F.col("x")).alias("m")).collect()
    for r in got:
        assert r["p"] == H.signed64(r["x"] * H.MIX_A) and r["m"] == H.signed64(H.mix64_py(r["x"]))


def natural_less(a, b):
    """Natural order by comparing the names run by run."""
    import itertools
    import re

    pa, pb = re.findall("[0-9]+|[^0-9]", a), re.findall("[0-9]+|[^0-9]", b)
    for x, y in itertools.zip_longest(pa, pb):
        if x is None or y is None:
            return x is None
        if x.isdecimal() and y.isdecimal():
            if int(x) != int(y):
                return int(x) < int(y)
            if len(x) != len(y):
                return len(x) < len(y)
        elif x != y:
            return x[0] < y[0]
    return False


def test_natural_order(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("a0109/-") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    keys = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", N.natural_key(F.col("n")).alias("k")).collect()}
    for a, b in zip(names, names[1:], strict=False):
        assert keys[a] == N.natural_key_py(a)
        assert (keys[a] < keys[b]) == (a != b and natural_less(a, b))


def test_bins():
    assert bin_of(-1, 0) == 4680 and bin_of(0, 1) == 4681 and bin_of(0, 1 << 29) == 0 and bins_of(5, 5) == []
    rng = random.Random(3)
    for _ in range(300):
        a = rng.randrange(1 << 29)
        b = min(a + rng.randrange(1, 1 << rng.randrange(1, 29)), 1 << 29)
        c = rng.randrange(1 << 29)
        d = min(c + rng.randrange(1, 1 << 20), 1 << 29)
        if a < d and c < b:
            assert bin_of(c, d) in bins_of(a, b)


def test_cigar_functions(spark):
    one = spark.createDataFrame([("3S4=1X2I3D5M2H", 10), ("*", -1), ("0M", 5)], "c string, pos int").withColumn("ops", parse_cigar(F.col("c")))
    r, star, zero = one.select(
        C.format_cigar(F.col("ops")).alias("t"),
        C.reference_length(F.col("ops")).alias("ref"),
        C.query_length(F.col("ops")).alias("query"),
        C.cigar_stats(F.col("ops")).alias("s"),
        C.aligned_bounds(F.col("ops")).alias("b"),
        C.reg2bins(F.col("pos"), F.col("pos") + 10).alias("bins"),
        C.spans(F.col("pos"), F.col("ops")).alias("spans"),
    ).collect()
    assert (r["t"], r["ref"], r["query"]) == ("3S4=1X2I3D5M2H", 13, 15) and (star["t"], star["ref"]) == ("*", 0) and zero["t"] == "0M"
    s = r["s"]
    assert (s["matches"], s["mismatches"], s["insertions"], s["deletions"], s["aligned_bases"]) == (9, 1, 2, 3, 12)
    assert s["identity"] == pytest.approx(60.0) and s["gap_compressed_identity"] == pytest.approx(75.0) and star["s"]["identity"] == 0
    assert tuple(r["b"]) == (3, 15) and r["bins"] == bins_of(10, 20) and [tuple(x) for x in r["spans"]] == [(10, 23)]
    for bad in ("5", "M", "5Q", "-5M", "268435456M"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "c string").select(parse_cigar(F.col("c"))).collect()


def test_regions():
    parse = region.parse_region
    assert parse("*") == region.Region(None) and parse("chr1") == region.Region("chr1")
    assert parse("chr1:5-9") == region.Region("chr1", 4, 9) and parse("a:b:0-3") == region.Region("a:b", 0, 3) and parse("x:7").beg == 6
    for bad in ("", "x:9-8", "x:a-b", ":5", "x:5-"):
        with pytest.raises(ValueError):
            parse(bad)


def test_headers():
    text = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:a\tLN:5\tM5:x\n@RG\tID:r/1--2\tBC:A\tDS:READTYPE=CCS; BarcodeFile = f;x\n@RG\tID:r/3--4\n@PG\tID:p\n@PG\tID:lima\tPP:p\n@PG\tID:q\tPP:lima\n@CO\tone\ttwo\n@XX\tskipped\n"
    h = parse_header(text)
    assert h.to_text() == text.replace("@XX\tskipped\n", "") and h.read_groups[0].ds == [("READTYPE", "CCS"), ("BarcodeFile", "f")]
    for bad in ("@HD\tVN:1\n@HD\tVN:1\n", "@SQ\tSN:a\n", "@SQ\tSN:a\tLN:0\n", "@SQ\tSN:a\tLN:1\n@SQ\tSN:a\tLN:1\n", "@RG\tPL:x\n", "@RG\tID:a\n@RG\tID:a\n", "@CO\n", "@SQ\tSN:a\tLN:1\tLN:2\n"):
        with pytest.raises(ValueError):
            parse_header(bad)
    u = undone_header(h)
    assert [g.key for g in u.read_groups] == ["r"] and u.read_groups[0].ds == [("READTYPE", "CCS")] and "BC" not in u.read_groups[0].tags
    assert [(p.key, p.tags.get("PP")) for p in u.programs] == [("p", None), ("q", "p"), ("readloom.undo", "q")]
    other = parse_header("@SQ\tSN:a\tLN:5\tM5:y\n@RG\tID:z\n@CO\tmore\n")
    m = merge_union([h, other])
    assert [g.key for g in m.read_groups] == ["r/1--2", "r/3--4", "z"] and m.comments == ["one\ttwo", "more"] and m.references[0].tags["M5"] == "x"
    with pytest.raises(ValueError):
        collection_union([h, other])
    with pytest.raises(ValueError):
        merge_union([h, Header()])
    for _ in range(2):
        add_program(m, "q")
    assert [p.key for p in m.programs][-2:] == ["q.1", "q.2"] and m.programs[-1].tags["PP"] == "q.1"


def test_merge_modes():
    assert sort.merge_mode(["coordinate"] * 2) == "coordinate" and sort.merge_mode(["", "unknown"]) == "concat"
    assert sort.merge_mode(["coordinate", "queryname"], concat_requested=True) == "concat"
    for bad in ([], ["coordinate", "queryname"], ["coordinate", ""]):
        with pytest.raises(ValueError):
            sort.merge_mode(bad)
    with pytest.raises(ValueError):
        sort.check_merge_order(["coordinate", "queryname"], "coordinate")


def test_minimiser():
    seq = "ACGT" * 30
    value, place = sort.minimiser(seq)

    def code(kmer):
        h = 0
        for c in kmer:
            h = h << 2 | "ACGT".index(c)
        return (h ^ sort.FLIP) & sort.MASK

    best = min((code(seq[i : i + 20]), i) for i in range(len(seq) - 19))
    assert (value, place) == (best[0] + (1 << 30), 65535 - best[1])
    assert sort.minimiser("ACGT")[0] == (1 << 30) - 1 and sort.minimiser("N" * 25) == sort.minimiser("A" * 25)


def test_mate_golden(spark):
    rows = [(0, 0, 99, 100, 2), (1, 1, 99, 200, 0), (2, 2, 147, 300, -1), (3, 3, 147, 1500, -1)]
    reads = spark.createDataFrame(rows, "rec_no bigint, ord bigint, flag int, pos int, nf int").withColumns({"ref_id": F.lit(0), "slice": F.lit(0), "cigar": parse_cigar(F.lit("50M"))})
    got = sorted((r["rec_no"], r["next_pos"], r["tlen"]) for r in index.resolve_mates(reads).collect())
    assert got == [(0, 1500, 1450), (1, 300, 150), (2, 200, -150), (3, 100, -1450)]


def test_cram_with_reference_keeps_records(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(">ref\nACGTACGTACGTacgtacgtACGTNCGTAC\n>ref2\nTTTTGGGGCCCCAAAA\n")
    lines = [
        ("match", 0, "ref", 1, "30M", "ACGTACGTACGTACGTACGTACGTNCGTAC"),
        ("subst", 16, "ref", 3, "2S8M2I5M3D6M", "TTGTACATACNNGTACGGRNCGT"),
        ("eqx", 0, "ref", 11, "4=1X5=", "GTACTTACGT"),
        ("pastend", 0, "ref2", 13, "8M", "AAAAGGGG"),
    ]
    text = "@HD\tVN:1.6\tSO:unknown\n@SQ\tSN:ref\tLN:30\n@SQ\tSN:ref2\tLN:16\n"
    text += "".join(f"{n}\t{f}\t{r}\t{p}\t60\t{c}\t*\t0\t0\t{s}\t{'?' * len(s)}\n" for n, f, r, p, c, s in lines) + "unmapped\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t????\n"
    (tmp_path / "in.sam").write_text(text)
    assert main(["convert", "--reference", str(tmp_path / "ref.fa"), str(tmp_path / "in.sam"), str(tmp_path / "out.cram")]) == 0
    from readloom.sources import cram

    assert [r.tags["M5"] for r in cram.read_header(str(tmp_path / "out.cram")).references] == ["e6db79b744cd9475e4325b08ac87fabe", "aca9e0e1019366b28c22c661b728ae6a"]
    got = cram.read_cram(spark, str(tmp_path / "out.cram"), reference=str(tmp_path / "ref.fa")).orderBy("rec_no").collect()
    cigars = [c.replace("4=1X5=", "10M") for *_, c, _ in lines] + [""]
    assert [r["seq"] for r in got] == [s for *_, s in lines] + ["ACGT"]
    assert ["".join(f"{o['len']}{o['op']}" for o in r["cigar"]) for r in got] == cigars
    (tmp_path / "empty.fa").write_text("")
    assert main(["convert", "--reference", str(tmp_path / "empty.fa"), str(tmp_path / "in.sam"), str(tmp_path / "x.cram")]) == 1


def test_coalescing_in_stretches_changes_nothing(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(600):
        beg = rng.randrange(3000)
        rows.append((rng.randrange(3), beg, beg + rng.randrange(1, 12)))
    ranges = spark.createDataFrame(rows, "k int, beg bigint, end bigint")
    want = []
    for k in range(3):
        out = []
        for beg, end in sorted((b, e) for kk, b, e in rows if kk == k):
            if out and beg <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([beg, end])
        want += [(k, b, e) for b, e in out]
    for span in (None, 1, 100, 10**6):
        assert sorted(tuple(r) for r in index.coalesce_ranges(ranges, ["k"], span).collect()) == sorted(want)
