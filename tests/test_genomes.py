"""The parser of annotated genomes and its data source."""

import gzip

import pytest

from cohortloom.sources import genomes

PAD = " " * 21


def flat(name, features, sequence=None, end=True):
    lines = [f"LOCUS       {name} 100 bp DNA", "DEFINITION  x", "FEATURES             Location/Qualifiers", "     source          1..100", f'{PAD}/note="not a /CDS"']
    for location, values in features:
        lines += ["     gene            1..9", f'{PAD}/gene="g"', f"     CDS             {location}"] + [PAD + v for v in values]
    if sequence is not None:
        lines += ["ORIGIN"] + [f"{k + 1:9d} " + " ".join(sequence[k : k + 60][j : j + 10] for j in range(0, 60, 10)).strip() for k in range(0, len(sequence), 60)]
    return "\n".join(lines + ["//"] * end) + "\n"


def rows(text):
    return [(r[1], r[3], r[7], r[8], r[9], r[10], r[11], r[12]) for r in genomes.parsed("f", iter(text.splitlines()))]


def test_locations():
    p = genomes.segments
    assert p("3..9") == [(3, 9, 1, False, False)] and p("<3..>9") == [(3, 9, 1, True, True)] and p("7") == [(7, 7, 1, False, False)]
    assert [x[:3] for x in p("complement(join(1..3,7..9))")] == [(7, 9, -1), (1, 3, -1)]
    assert [x[:3] for x in p("join(complement(7..9),complement(1..3))")] == [(7, 9, -1), (1, 3, -1)]
    assert [x[:3] for x in p("join(90..100,1..5)")] == [(90, 100, 1), (1, 5, 1)] and [x[:3] for x in p("order(1..2, 4..5)")] == [(1, 2, 1), (4, 5, 1)]
    for bad in ("", "x", "3..", "9..3", "0..4", "join(1..2", "1..2)", "AB123.1:1..5", "3^4", "complement()", "one-of(1..2)"):
        with pytest.raises(genomes.BadLocation):
            p(bad)


def test_proteins_by_location():
    cds = "atggctgattgggtttaa"  # MADWV
    back = cds.translate(str.maketrans("acgt", "tgca"))[::-1]
    seq = cds + "cc" + back + "cc" + cds[:8] + "ttttt" + cds[8:]
    features = [
        ("1..18", ['/locus_tag="a"']),
        ("complement(21..38)", ['/locus_tag="b"']),
        ("join(41..48,54..63)", ['/locus_tag="c"']),
        ("<4..18", ['/locus_tag="d"', "/codon_start=1"]),
        ("3..18", ['/locus_tag="e"', "/codon_start=2"]),
        ("1..18", ['/locus_tag="f"', '/translation="MKV', "LLA", 'PQ"', '/product="two', 'words ""x"""']),
        ("1..18", ['/locus_tag="g"', "/pseudo"]),
        ("1..999", ['/locus_tag="h"']),
        ("1..18", ['/locus_tag="i"', "/transl_table=99"]),
        ("complement(join(1..3,", [f"{'30..40))'}", '/locus_tag="j"']),
        ("oops", ['/locus_tag="k"']),
    ]
    got = {r[1]: r for r in rows(flat("c1", features, seq))}
    assert {k: got[k][6] for k in "abcdef"} == {"a": "MADWV", "b": "MADWV", "c": "MADWV", "d": "ADWV", "e": "ADWV", "f": "MKVLLAPQ"}
    assert {k: got[k][7] for k in "ghik"} == {"g": "pseudo", "h": "location", "i": "table", "k": "location"} and all(got[k][6] is None for k in "ghik")
    assert got["j"][2] == "complement(join(1..3,30..40))" and got["j"][3:6] == (1, 40, -1) and got["b"][3:6] == (21, 38, -1)
    product = next(r[6] for r in genomes.parsed("f", iter(flat("c1", features, seq).splitlines())) if r[3] == "f")
    assert product == 'two words "x"'
    assert rows(flat("c", [("1..6", ['/locus_tag="z"'])], None))[0][7] == "sequence"
    assert rows(flat("c", [("1..12", ['/locus_tag="z"'])], "atgtaagctgct"))[0][6:] == (None, "stop")
    assert rows(flat("c", [("1..9", ["/transl_table=4"])], "ttgtgannn"))[0][6] == "MWX"


def test_broken_and_empty_files():
    good = flat("c1", [("1..3", ['/translation="M"'])])
    assert [r[7] for r in rows(flat("c0", [("1..3", [])], None, end=False) + good)] == ["format", None]
    assert [r[7] for r in rows(good + "LOCUS       c2\nFEATURES\n")] == [None, "format"]
    assert [r[7] for r in rows("")] == ["empty"] and [r[7] for r in rows("no record\n")] == ["empty"] and rows(flat("c", [])) == []


def test_data_source(spark, tmp_path):
    seq = "atg" + "gct" * 10 + "taa"
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "a.gbff").write_text(flat("c1", [("1..36", ['/locus_tag="x"'])], seq) + flat("c2", [("1..36", ['/locus_tag="y"'])], seq))
    with gzip.open(tmp_path / "b.gbff.gz", "wt") as f:
        f.write("".join(flat(f"k{k}", [("complement(1..36)", ['/locus_tag="z"', '/translation="MA"'])], seq) for k in range(3000)))
    (tmp_path / "c.gbk").write_text("")
    (tmp_path / "d.gbff.gz").write_bytes(b"not gzipped")
    (tmp_path / "e.txt").write_text("left out")
    df = genomes.proteins(spark, str(tmp_path))
    got = df.collect()
    assert len([r for r in got if r.protein == "MA"]) == 3000 and {r.locus_tag: r.protein for r in got if r.contig in ("c1", "c2")} == {"x": "M" + "A" * 10, "y": "M" + "A" * 10}
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in got if r.reason) == [("c.gbk", "empty"), ("d.gbff.gz", "file")]
    assert genomes.proteins(spark, str(tmp_path), "*.none").count() == 0
    shares = genomes._Reader({"files": "\n".join(f"{k}\t{size}" for k, size in enumerate([100 << 20, 5, 70 << 20, 40 << 20, 40 << 20, 9]))}).partitions()
    assert [p.paths for p in shares] == [["0"], ["2"], ["3"], ["4", "5", "1"]]
