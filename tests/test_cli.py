import json
import os

import pytest

from readloom.cli import main
from readloom.sources import bam, indexes, sam
from tests.samples import HEADER, LINES, write_sam


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    write_sam(d / "a.sam")
    assert main(["sort", f"{d}/a.sam", f"{d}/s.bam"]) == 0
    return d


def lines(capsys):
    return [x for x in capsys.readouterr().out.splitlines() if not x.startswith("@")]


def names(text):
    return [x.split("\t")[0] for x in text]


def test_help_and_errors(files, capsys):
    assert main([]) == 0 and "dump" in capsys.readouterr().out
    assert main(["nonsense"]) == 1 and main(["dump", f"{files}/none.bam"]) == 1
    assert main(["dump", "--no-header", "--header-only", f"{files}/s.bam"]) == 1
    assert main(["dump", "--region", "chr1", f"{files}/s.bam"]) == 1
    assert main(["subsample", f"{files}/s.bam", f"{files}/x.bam"]) == 1
    assert main(["sort", "--order", "tag", f"{files}/s.bam", f"{files}/x.bam"]) == 1


def test_dump(files, capsys):
    assert main(["dump", f"{files}/a.sam"]) == 0
    assert names(lines(capsys)) == names(LINES)
    assert main(["dump", "--header-only", f"{files}/s.bam"]) == 0
    out = capsys.readouterr().out
    assert "SO:coordinate" in out and "ID:readloom.sort" in out and "PP:maker" in out


def test_sort_orders(files, capsys):
    for order, want in (("queryname", sorted(names(LINES))), ("tag", None)):
        assert main(["sort", "--order", order, "--tag", "zm", f"{files}/a.sam", f"{files}/q.bam"]) == 0
        main(["dump", "--no-header", f"{files}/q.bam"])
        got = names(lines(capsys))
        assert got == want if want else got[:2] == ["m/3/ccs", "m/3/ccs"]  # without the tag, first
    assert main(["sort", "--minimise", f"{files}/a.sam", f"{files}/q.bam"]) == 0
    assert bam.read_header(f"{files}/q.bam")[0].hd["SS"] == "coordinate:minhash"


def test_indexes_and_queries(files, capsys):
    path = f"{files}/s.bam"
    assert main(["bai-build", path]) == 0 and os.path.exists(path + ".bai")
    capsys.readouterr()
    assert main(["bai-query", path, "chr1:14-110"]) == 0
    assert names(lines(capsys)) == ["m/1/0_10", "m/1/10_20", "m/2/0_12"]
    assert main(["bai-query", path, "chrX"]) == 1
    assert main(["zmi-index", "--quiet", path]) == 0 and indexes.read_bai(path + ".bai").counts() == (6, 1, 1)
    capsys.readouterr()
    assert main(["zmi-query", path, "1"]) == 0 and len(lines(capsys)) == 2
    parts = []
    for k in (1, 2, 3):
        assert main(["chunk", path, f"{k}/3"]) == 0
        parts.append(lines(capsys))
    assert sorted(names(sum(parts, []))) == sorted(names(LINES)) and all(parts)
    got = []
    for k in (1, 2):
        assert main(["chunk", path, f"{k}/2", "--mode", "scatter", "--tile", "2", "--seed", "3"]) == 0
        got += names(lines(capsys))
    assert sorted(got) == sorted(names(LINES))
    assert main(["zmi-build", path, f"{files}/copy.bam"]) == 0 and os.path.exists(f"{files}/copy.bam.zmi")


def test_merge_and_concat(files, capsys):
    path = f"{files}/s.bam"
    assert main(["merge", f"{files}/m.bam", path, path, "--bai"]) == 0 and os.path.exists(f"{files}/m.bam.bai")
    main(["dump", "--no-header", f"{files}/m.bam"])
    got = names(lines(capsys))
    assert len(got) == 2 * len(LINES) and got[0] == got[1]
    assert main(["merge", "--concat", f"{files}/c.bam", path, f"{files}/a.sam"]) == 0
    assert bam.read_header(f"{files}/c.bam")[0].sort_order == "unsorted"
    assert main(["merge", "--order", "queryname", f"{files}/x.bam", path, path]) == 1


def test_depth_and_status(files):
    assert main(["depth", "--bin-size", "400", "--status-json", f"{files}/d.jsonl", f"{files}/s.bam", f"{files}/d.tsv"]) == 0
    rows = [x.split("\t") for x in open(f"{files}/d.tsv").read().splitlines()]
    assert rows[0] == ["#contig", "start", "end", "mean_depth"] and [r[:3] for r in rows[1:]] == [["chr1", "0", "400"], ["chr1", "400", "800"], ["chr1", "800", "1000"], ["chr2", "0", "400"], ["chr2", "400", "500"]]
    # 10 + 6 + (4 + 2 + 3 + 4) + (5 + 5) + 10 bases; the secondary record doesn't count.
    assert float(rows[1][3]) * 400 == pytest.approx(49) and rows[2][3] == "0" and rows[4][3] == "0"
    final = json.loads(open(f"{files}/d.jsonl").read().splitlines()[-1])
    assert final["event"] == "final" and final["metrics"]["depth_bases"] == 49


def test_subsample_convert_undo(files, spark):
    assert main(["subsample", "--fraction", "1", "--strip-kinetics", f"{files}/s.bam", f"{files}/f.bam"]) == 0
    assert bam.read_bam(spark, f"{files}/f.bam").count() == len(LINES)
    assert main(["subsample", "--yield", "20", "--seed", "5", f"{files}/s.bam", f"{files}/y.bam"]) == 0
    header = bam.read_header(f"{files}/y.bam")[0]
    assert header.comments[-1] == "Sub-sampled yield=20 seed=5" and 0 < bam.read_bam(spark, f"{files}/y.bam").count() < len(LINES)
    assert main(["convert", "--write-crai", f"{files}/s.bam", f"{files}/s.cram"]) == 0
    assert main(["convert", f"{files}/s.cram", f"{files}/back.sam"]) == 0
    assert sam.read_sam(spark, f"{files}/back.sam").count() == len(LINES)
    assert main(["dump", "--region", "chr2:40-60", f"{files}/s.cram"]) == 0
    assert main(["undo", f"{files}/s.bam", f"{files}/u.bam"]) == 0 and HEADER
    assert bam.read_bam(spark, f"{files}/u.bam").count() == len(LINES)


def test_bench(files, capsys):
    assert main(["bench", f"{files}/s.bam"]) == 0 and len(capsys.readouterr().out.splitlines()) == 7


def test_merge_passes_disjoint_inputs_through(files, capsys):
    for name, chosen in (("low", ("chr1",)), ("high", ("chr2", "*"))):
        kept = [x for x in LINES if x.split("\t")[2] in chosen]
        (files / f"{name}.sam").write_text(HEADER + "\n".join(kept) + "\n")
        assert main(["sort", f"{files}/{name}.sam", f"{files}/{name}.bam"]) == 0
    capsys.readouterr()
    outputs = {}
    for flag, mode in ((["--status-json", f"{files}/m.json"], "passthrough"), (["--no-passthrough", "--status-json", f"{files}/m.json"], "sort")):
        assert main(["merge", f"{files}/m.bam", f"{files}/high.bam", f"{files}/low.bam", *flag]) == 0
        report = [json.loads(x) for x in open(f"{files}/m.json")][-1]["metrics"]
        assert report["mode"] == mode and report["inputs"] == 2 and report["records"] == len(LINES) and report["output_bytes"] > 0
        main(["dump", "--no-header", f"{files}/m.bam"])
        outputs[mode] = lines(capsys)
    assert outputs["passthrough"] == outputs["sort"]
    assert main(["merge", f"{files}/m.bam", f"{files}/low.bam", f"{files}/low.bam", "--status-json", f"{files}/m.json"]) == 0
    assert [json.loads(x) for x in open(f"{files}/m.json")][-1]["metrics"]["mode"] == "sort"


def test_input_from_streams(files, capsys, monkeypatch):
    import io
    import sys
    import threading

    main(["dump", "--no-header", f"{files}/s.bam"])
    want = lines(capsys)
    for name in ("s.bam", "a.sam"):
        data = (files / name).read_bytes()
        monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(data)})())
        assert main(["dump", "--no-header", "-"]) == 0
        assert sorted(lines(capsys)) == sorted(want)
    fifo = f"{files}/pipe"
    os.mkfifo(fifo)
    writer = threading.Thread(target=lambda: open(fifo, "wb").write((files / "s.bam").read_bytes()))
    writer.start()
    assert main(["dump", "--no-header", fifo]) == 0
    writer.join()
    assert lines(capsys) == want
