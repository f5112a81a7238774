import os
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.header import parse_header
from readloom.sources import cram as C
from readloom.sources import cram_codecs as K
from readloom.sources import cram_columns as X
from readloom.sources import sam
from readloom.sources.bam import batch
from readloom.sources.columns import rows_of_batch
from readloom.sources.fasta import Fasta
from readloom.sources.records import tag
from tests.samples import write_sam

FIELDS = ["qname", "flag", "ref_id", "rname", "pos", "mapq", "cigar", "next_ref_id", "next_pos", "tlen", "seq", "qual", "tags"]


@given(st.integers(-(2**31), 2**31 - 1), st.integers(-(2**63), 2**63 - 1))
def test_integers(a, b):
    assert K.Cursor(K.itf8(a)).itf8() == a and K.Cursor(K.ltf8(b)).ltf8() == b


@given(st.binary(max_size=3000) | st.lists(st.sampled_from([0, 1, 2, 7]), max_size=3000).map(bytes))
def test_rans_round_trip(data):
    assert K.rans_decode(K.rans_encode(data)) == data


@pytest.mark.parametrize("method", sorted(K.COMPRESS))
def test_block_methods(method):
    data = b"ACGTACGTTT" * 500
    block = C.format_block(C.EXTERNAL, 7, data, (method,))
    got = C.parse_block(K.Cursor(block))
    assert (got.kind, got.content_id, got.data) == (C.EXTERNAL, 7, data) and (method == K.RAW or len(block) < 3000)
    broken = bytearray(block)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        C.parse_block(K.Cursor(bytes(broken)))


def test_unsupported_method_says_so():
    with pytest.raises(ValueError, match="fqzcomp"):
        K.decompress(7, b"", 0)
    K.register_method(99, lambda b: b[::-1], lambda b: b[::-1])
    assert K.decompress(99, b"ab", 2) == b"ba"


def bits(text):
    return K.Bits(int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big"))


def encoding(kind, *params):
    p = b"".join(map(K.itf8, params))
    return K.Encoding(K.Cursor(K.itf8(kind) + K.itf8(len(p)) + p))


def test_bit_encodings():
    huffman = encoding(3, 3, 10, 20, 30, 3, 1, 2, 2)
    assert [huffman.number(b, {}) for b in [bits("01011")] for _ in range(3)] == [10, 20, 30]
    assert encoding(3, 1, 5, 1, 0).number(bits("0"), {}) == 5
    beta = encoding(6, 2, 4)
    assert beta.number(bits("1010"), {}) == 8
    gamma = encoding(9, 1)
    assert [gamma.number(b, {}) for b in [bits("1010011")] for _ in range(3)] == [0, 1, 2]
    sub = encoding(7, 0, 2)
    assert [sub.number(b, {}) for b in [bits("001" + "1001" + "11001")] for _ in range(2)] == [1, 5]
    with pytest.raises(ValueError):
        encoding(2, 0, 0)


HEADER = parse_header("@HD\tVN:1.6\n@SQ\tSN:c1\tLN:3000\n@SQ\tSN:c2\tLN:2000\n@RG\tID:g1\n@RG\tID:g2\n")


def fasta_file(tmp_path, rng):
    seqs = {"c1": "".join(rng.choice("ACGT") for _ in range(3000)), "c2": "".join(rng.choice("ACGTN") for _ in range(2000))}
    path = tmp_path / "r.fa"
    path.write_text("".join(f">{n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in seqs.items()))
    return str(path), seqs


def rows(rng, seqs, n):
    out = []
    for i in range(n):
        ref = rng.choice([0, 0, 1, -1])
        if ref < 0:
            seq, cigar, pos, flag = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(40))), [], -1, 4
        else:
            name, pos, cigar, parts = ("c1", "c2")[ref], rng.randrange(1500), [], []
            at, flag = pos, rng.choice([0, 16, 99, 147, 256])
            for op in rng.choice(["M", "SMIMDMNMS", "HMPMH", "MIM"]):
                k = rng.randint(1, 30)
                cigar.append({"op": op, "len": k})
                if op == "M":
                    parts.append("".join(rng.choice("ACGTNR") if rng.random() < 0.1 else b for b in seqs[name][at : at + k]))
                elif op in "SI":
                    parts.append("".join(rng.choice("ACGT") for _ in range(k)))
                at += k if op in "MDN" else 0
            seq = "".join(parts)
            merged = []
            for o in cigar:
                if merged and merged[-1]["op"] == o["op"]:
                    merged[-1] = {"op": o["op"], "len": merged[-1]["len"] + o["len"]}
                else:
                    merged.append(o)
            cigar = merged
        tags = {"NM": tag("i", i=rng.choice([1, 300, -5]))} if i % 2 else {"XX": tag("Z", s="x y"), "YB": tag("B", et="s", ai=[-3, 4])}
        if i % 3 == 0:
            tags["RG"] = tag("Z", s=rng.choice(["g1", "g2", "other"]))
        qual = bytes(rng.randrange(50) for _ in seq) if seq and rng.random() < 0.8 else None
        out.append(
            {"qname": f"r{i}", "flag": flag, "ref_id": ref, "rname": HEADER.reference_name(ref), "pos": pos, "mapq": rng.randrange(60), "cigar": cigar}
            | {"next_ref_id": rng.choice([-1, 0]), "next_pos": rng.randrange(-1, 90), "tlen": rng.randrange(-99, 99), "seq": seq, "qual": qual, "tags": tags}
        )
        if ref < 0:
            out[-1]["mapq"] = 0
    return out


@pytest.mark.parametrize("with_reference", [False, True])
@pytest.mark.parametrize("methods", [(K.GZIP,), (K.RANS, K.BZIP2, K.LZMA), (5,), (6,)])
def test_container_round_trip(tmp_path, with_reference, methods):
    rng = random.Random(3)
    path, seqs = fasta_file(tmp_path, rng)
    fasta = Fasta(path) if with_reference else None
    groups = [rows(rng, seqs, 120), [r for r in rows(rng, seqs, 200) if r["ref_id"] == 1], rows(rng, seqs, 1)]
    out = str(tmp_path / "x.cram")
    index = C.assemble(None, out, HEADER, list([C.encode_container(g, HEADER, fasta, methods) for g in groups]))
    header, found = C.containers(out)
    assert header.to_text() == HEADER.to_text() and C.has_eof(out) and [c.records for c in found] == [len(g) for g in groups]
    got = [r for c in found for _, part in C.read_container(out, c, header, fasta) for r in part]
    want = [r for g in groups for r in g]
    for a, b in zip(got, want, strict=True):
        assert {k: a[k] for k in FIELDS} == {k: b[k] for k in FIELDS}
    assert [i[0] for i in index if i[3] == found[1].offset] == [1] and {i[0] for i in index} == {0, 1, -1}


PLACES = {"file_ord": None, "rec_no": None, "voffset": None, "next_rname": "*"}


@pytest.mark.parametrize("seed", range(6))
def test_series_at_a_time_and_record_by_record_agree(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    _, seqs = fasta_file(tmp_path, rng)
    made = rows(rng, seqs, 150) if seed < 4 else [r for r in rows(rng, seqs, 150) if (r["ref_id"] == 1) == (seed == 4)]
    for r in made:
        if rng.random() < 0.2:
            r["tags"] |= {"ip": tag("B", et="C", ai=[rng.randrange(256) for _ in r["seq"]]), "sn": tag("B", et="f", af=[0.5, -2.0]), "rq": tag("f", f=0.25), "cc": tag("A", s="q")}
        if rng.random() < 0.2:
            r["tags"] |= {"YB": tag("B", et=rng.choice("cSI"), ai=[1, 100] * rng.randrange(3)), "bi": tag("i", i=rng.choice([2**31, -(2**31), 70_000, 127, 255]))}
        if rng.random() < 0.1 and r["qual"]:
            r["qual"] = bytes([255]) * len(r["seq"])
    plain = C.encode_container(made, HEADER, None)
    columns = batch([r | PLACES for r in made], None)
    monkeypatch.setattr(C, "encode_container", None)
    assert C.encode_columns(columns, HEADER) == plain
    path = str(tmp_path / "x.cram")
    C.assemble(None, path, HEADER, [plain])
    header, (one,) = C.containers(path)
    for wanted in (None, lambda key: key in ("ip", "RG", "YB")):
        want = [r for _, part in C.read_container(path, one, header, None, wanted) for r in part]
        with monkeypatch.context() as m:
            m.setattr(C, "decode_slice", None)
            ((_, got),) = C.read_batches(path, one, header, None, wanted)
        got.validate(full=True)
        assert rows_of_batch(got) == [PLACES | r for r in want]


def test_records_out_of_the_ordinary_are_taken_one_by_one(tmp_path):
    _, seqs = fasta_file(tmp_path, random.Random(1))
    usual = rows(random.Random(1), seqs, 30)
    some = next(r for r in usual if r["cigar"] and r["seq"])
    for change in ({"qname": "é"}, {"seq": "", "qual": None}, {"cigar": []}, {"tags": {"zz": tag("Z", s="ü")}}):
        made = [*usual, some | change]
        coded = C.encode_columns(batch([r | PLACES for r in made], None), HEADER)
        assert coded == C.encode_container(made, HEADER, None)
        path = str(tmp_path / "x.cram")
        C.assemble(None, path, HEADER, [coded])
        header, (one,) = C.containers(path)
        want = [r for _, part in C.read_container(path, one, header, None) for r in part]
        got = [r for _, part in C.read_batches(path, one, header, None) for r in rows_of_batch(part)]
        assert [{k: r[k] for k in FIELDS} for r in got] == [{k: r[k] for k in FIELDS} for r in want]
    with pytest.raises(Exception, match="out of range|format requires"):
        C.encode_columns(batch([usual[0] | PLACES | {"tags": {"xx": tag("B", et="C", ai=[256])}}], None), HEADER)
    with pytest.raises(ValueError, match="out of range"):
        C.encode_columns(batch([usual[0] | PLACES | {"tags": {"xx": tag("i", i=2**40)}}], None), HEADER)


@given(st.lists(st.integers(-(2**31), 2**31 - 1) | st.integers(-1, 200)))
def test_integers_at_once(values):
    import numpy as np

    coded = X.itf8_all(np.array(values, np.int64))
    assert coded == b"".join(map(K.itf8, values)) and X.read_itf8(coded + b"\xff", len(values)).tolist() == values


@given(st.lists(st.lists(st.integers(0, 9), max_size=7), max_size=6), st.integers(1, 5), st.integers(1, 20))
def test_slices_end_with_the_row_that_fills_them(batches, records, bases):
    got = [[len(s) for s in b.column("seq").to_pylist()] for b in C.sliced((pa.RecordBatch.from_pydict({"seq": pa.array(["A" * n for n in x], pa.string())}) for x in batches), records, bases)]
    want, held = [], []
    for n in [n for x in batches for n in x]:
        held.append(n)
        if len(held) >= records or sum(held) >= bases:
            want, held = [*want, held], []
    assert got == want + ([held] if held else [])


def test_wrong_reference_is_noticed(tmp_path):
    rng = random.Random(4)
    path, seqs = fasta_file(tmp_path, rng)
    one = [r for r in rows(rng, seqs, 60) if r["ref_id"] == 0]
    out = str(tmp_path / "x.cram")
    C.assemble(None, out, HEADER, list([C.encode_container(one, HEADER, Fasta(path))]))
    other, _ = fasta_file(tmp_path, random.Random(99))
    header, found = C.containers(out)
    with pytest.raises(ValueError, match="reference differs"):
        list(C.read_container(out, found[0], header, Fasta(other)))
    assert all("N" in r["seq"] for _, part in C.read_container(out, found[0], header, None) for r in part)


def test_data_source(spark, tmp_path):
    sam_path = write_sam(tmp_path / "a.sam")
    reads, header = sam.read_sam(spark, sam_path), sam.read_header(sam_path)
    path = str(tmp_path / "a.cram")
    C.write_cram(reads.orderBy("rec_no"), path, header, slice_records=2, crai="true")
    back = C.read_cram(spark, path).orderBy("rec_no")
    same = [f for f in FIELDS if f != "tags"]
    assert [tuple(r[f] for f in same) for r in back.collect()] == [tuple(r[f] for f in same) for r in reads.orderBy("rec_no").collect()]
    assert back.first()["tags"]["RG"]["s"] == "a1b2c3d4"
    chr2 = C.read_cram(spark, path).where((F.col("ref_id") == 1) & (F.col("pos") < 400))
    assert [r["qname"] for r in chr2.collect()] == ["m/4/0_3"]
    os.remove(path + ".crai")
    assert C.read_cram(spark, path).where("ref_id = 0").count() == 5
    some = C.containers(path)[1][1]
    assert C.read_cram(spark, path, slice=f"{some.offset}").count() == 2
    assert {k for r in C.read_cram(spark, path, keep_tags="zm").collect() for k in r["tags"]} == {"zm"}
