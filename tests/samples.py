"""Small inputs made for the tests."""

HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n@RG\tID:a1b2c3d4\tSM:s\tDS:READTYPE=CCS;BarcodeFile=x\n@PG\tID:maker\tPN:maker\n@CO\tfree text\n"
LINES = [
    "m/1/0_10\t0\tchr1\t11\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tRG:Z:a1b2c3d4\tzm:i:1\trq:f:0.999",
    "m/1/10_20\t16\tchr1\t15\t60\t2S6M2S\t*\t0\t0\tACGTACGTAC\tABCDEFGHIJ\tbc:B:S,3,4\tzm:i:1",
    "m/2/0_12\t0\tchr1\t101\t30\t4M2I2M3D4M\tchr2\t41\t0\tACGTACGTACGT\t*\tNM:i:-5\tzm:i:2",
    "m/3/ccs\t99\tchr1\t201\t7\t5M10N5M\t=\t301\t110\tACGTACGTAC\t!!!!!!!!!!\tXA:A:c\tXB:B:f,1.5,2\tXH:H:1AF0",
    "m/3/ccs\t147\tchr1\t301\t7\t10M\t=\t201\t-110\tNNNNNRYKMS\tIIIIIIIIII\tXZ:Z:a b c",
    "m/4/0_3\t256\tchr2\t41\t0\t3M\t*\t0\t0\t*\t*\tzm:i:4",
    "m/5/0_4\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tzm:i:5",
]


def write_sam(path):
    path.write_text(HEADER + "".join(line + "\n" for line in LINES))
    return str(path)
