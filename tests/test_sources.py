import gzip
import json
import os
import struct

import pytest

from strandloom.operators import intervals as iv
from strandloom.operators import science
from strandloom.operators import sequences as sq
from strandloom.sources import binary, sinks, text


@pytest.fixture
def spark_small(spark):
    """Blocks of 64 bytes, so that every file is split."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def read_all(folder):
    return "".join((gzip.open(f"{folder}/{f}", "rt") if f.endswith("gz") else open(f"{folder}/{f}")).read() for f in sorted(os.listdir(folder)) if f.startswith("part"))


def fastq_of(n):
    return "".join(f"@r{i} x\n{'ACGTN' * (i % 7)}\n+\n{'@III+' * (i % 7)}\n" for i in range(n))


def test_fastq_round_trip(spark_small, tmp_path):
    path = put(tmp_path / "r.fq", fastq_of(60))
    df = text.fastq(spark_small, path)
    rows = df.orderBy("ord").collect()
    assert [(r["ord"], r["id"], r["seq"]) for r in rows] == [(i, f"r{i} x", "ACGTN" * (i % 7)) for i in range(60)]
    sinks.write_fastq(df, str(tmp_path / "out"), single=True, gz=True)
    assert read_all(tmp_path / "out") == fastq_of(60)
    assert text.fastq(spark_small, str(tmp_path / "out")).count() == 60
    assert text.fastx(spark_small, path).columns == df.columns


@pytest.mark.parametrize("bad", ["@r\nAC\n+\nI\n", "r\nAC\n+\nII\n", "@r\nAC\n-\nII\n", "@r\nAC\n+\n", "@r\nAC\n+\nII\n@r2\n"])
def test_bad_fastq_is_an_error(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a FASTQ record"):
        text.fastq(spark, put(tmp_path / "bad.fq", bad)).collect()


def test_fasta(spark_small, tmp_path):
    path = put(tmp_path / "a.fa", ">c1 one\nACGTACGTAC\r\nACGT\n>c2\nGG\n\n>c3\n" + "\n".join(["ACGTACGT"] * 40) + "\nAC\n>c4\n")
    rows = [(r["ord"], r["id"], r["seq"]) for r in text.fasta(spark_small, path).orderBy("ord").collect()]
    assert rows == [(0, "c1 one", "ACGTACGTACACGT"), (1, "c2", "GG"), (2, "c3", "ACGTACGT" * 40 + "AC"), (3, "c4", "")]
    assert text.fastx(spark_small, path).filter("qual is null").count() == 4
    assert text.kmer_references(spark_small, [path], "acg,TT")[:2] == ["ACG", "TT"]
    sinks.write_fasta(text.fasta(spark_small, path), str(tmp_path / "out"), wrap=8, single=True)
    assert read_all(tmp_path / "out").startswith(">c1 one\nACGTACGT\nACACGT\n>c2\nGG\n>c3\nACGTACGT\n")


def test_fasta_index(spark_small, tmp_path):
    content = ">c1 one\nACGTACGTAC\nACGT\n>c2\nGG\n>c3\n" + "\n".join(["ACGTACGT"] * 40) + "\nAC\n"
    path = put(tmp_path / "a.fa", content)
    for r in text.fasta_index(spark_small, path).collect():
        i = content.index(f">{r['name']}")
        assert r["offset"] == content.index("\n", i) + 1
    index = {r["name"]: (r["length"], r["line_bases"], r["line_width"]) for r in text.fasta_index(spark_small, path).collect()}
    assert index == {"c1": (14, 10, 11), "c2": (2, 2, 3), "c3": (322, 8, 9)}
    sinks.write_fasta_index(text.fasta_index(spark_small, path), str(tmp_path / "fai"))
    assert read_all(tmp_path / "fai").split("\n")[0] == "c1\t14\t8\t10\t11"
    with pytest.raises(Exception, match="different length"):
        text.fasta_index(spark_small, put(tmp_path / "b.fa", ">x\nACG\nAC\nACG\n")).collect()


def test_bed(spark_small, tmp_path):
    path = put(tmp_path / "b.bed", "track x\n#c\nchr1\t10\t20\tn\t5\t+\nbrowser\nchr1\t15\t25\nchr2\t1\t2\t.\t.\t.\n\n")
    df = text.bed(spark_small, path)
    assert [(r["ord"], r["chrom"], r["chrom_start"], r["strand"]) for r in df.orderBy("ord").collect()] == [(2, "chr1", 10, "+"), (4, "chr1", 15, None), (5, "chr2", 1, None)]
    assert [tuple(r) for r in iv.merge(df).orderBy("chrom").collect()] == [("chr1", 10, 25), ("chr2", 1, 2)]
    sinks.write_bed(df, str(tmp_path / "out"), columns=6, single=True)
    assert read_all(tmp_path / "out") == "chr1\t10\t20\tn\t5\t+\nchr1\t15\t25\t.\t0\t.\nchr2\t1\t2\t.\t.\t.\n"
    bad = put(tmp_path / "bad.bed", "chr1\t5\nchr1\tx\t7\nchr1\t9\t9\n")
    with pytest.raises(Exception, match="not an interval"):
        text.bed(spark_small, bad).collect()
    assert text.bed(spark_small, bad, mode="permissive").count() == 1
    assert [tuple(r) for r in text.genome_sizes(spark_small, put(tmp_path / "g", "#x\nchr1\t100\nchr2\t50\n")).orderBy("place").select("chrom", "size").collect()] == [("chr1", 100), ("chr2", 50)]
    told = json.loads(sinks.envelope("bed-stats", "1", iv.stats(df)))
    assert told["status"] == "ok" and told["result"]["n"] == 3 and told["result"]["median"] == 10
    assert iv.stats(df.filter("false")).first()["n"] == 0


def test_gff_vcf_and_header(spark_small, tmp_path):
    gff = text.gff(spark_small, put(tmp_path / "g.gff", "##gff-version 3\nc\ts\tgene\t5\t9\t.\t+\t.\tID=a;N=b\nshort\tline\n"))
    assert gff.count() == 1 and text.gff_attributes(gff).first()["attribute_map"] == {"ID": "a", "N": "b"}
    body = "chr1\t5\t.\tA\tC,T\t.\tPASS\tX=1\tGT\t0/1\t1/1\nchr1\t7\trs\tAC\tA\t30.5\tq\t.\n"
    path = put(tmp_path / "v.vcf", "##x\n#CHROM\tPOS\n" + body)
    vcf, head = text.vcf(spark_small, path), text.header(spark_small, path)
    assert head == ["##x", "#CHROM\tPOS"] and [r["samples"] for r in vcf.orderBy("ord").collect()] == [["0/1", "1/1"], None]
    sinks.write_with_header(vcf, head, sinks.vcf_text(vcf), str(tmp_path / "out"))
    assert read_all(tmp_path / "out") == "##x\n#CHROM\tPOS\n" + body


def test_sam_and_bam(spark, tmp_path):
    sam = put(tmp_path / "x.sam", "@SQ\tSN:c1\tLN:100\nq\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tNM:i:3\nq2\t0\tc1\t5\t60\t2M\t=\t9\t3\tAC\tII\n")
    rows = text.sam(spark, sam).orderBy("ord").collect()
    assert [(r["rname"], r["flag"], r["tags"]) for r in rows] == [(None, 4, {"NM": "3"}), ("c1", 0, None)]
    assert [tuple(r)[:2] for r in text.sam_references(spark, sam).collect()] == [("c1", 100)]
    head = b"@HD\n"
    raw = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<ii", 1, 3) + b"c1\0" + struct.pack("<i", 100)
    record = struct.pack("<iiBBHHHiiii", 0, 4, 3, 60, 0, 1, 0, 3, -1, -1, 0) + b"q1\0" + struct.pack("<I", 3 << 4) + bytes([0x12, 0x40, 30, 31, 32])
    record += b"NMC\x03" + b"RGZgroup 1\0" + b"XAAq" + b"XBBs" + struct.pack("<ihh", 2, -5, 7) + b"XFf" + struct.pack("<f", 0.5) + b"XIi" + struct.pack("<i", -70000)
    raw += struct.pack("<i", len(record)) + record
    bam = put(tmp_path / "x.bam", gzip.compress(raw[:20]) + gzip.compress(raw[20:]))
    (r,) = binary.bam(spark, bam).collect()
    assert (r["qname"], r["rname"], r["pos"], r["mapq"], r["cigar"], r["rnext"], r["seq"], r["qual"]) == ("q1", "c1", 5, 60, "3M", None, "ACG", "?@A")
    assert r["tags"] == {"NM": "3", "RG": "group 1", "XA": "q", "XB": "s,-5,7", "XF": "0.5", "XI": "-70000"}
    assert [tuple(x) for x in binary.bam_references(spark, bam).collect()] == [("c1", 100, 0)]


def test_plink(spark, tmp_path):
    put(tmp_path / "p.bim", "1 v1 0 100 A C\n1 v2 0 200 G T\n")
    put(tmp_path / "p.fam", "".join(f"f s{i} 0 0 1 -9\n" for i in range(5)))
    put(tmp_path / "p.bed", b"\x6c\x1b\x01" + bytes([0b11100100, 0b00000011, 0, 0]))
    variants, samples, genotypes = binary.plink(spark, str(tmp_path / "p"))
    assert variants.count() == 2 and samples.count() == 5
    assert [r["gt"] for r in genotypes.orderBy("variant_idx", "sample_idx").collect()] == [2, None, 1, 0, 0, 2, 2, 2, 2, 2]
    put(tmp_path / "p.bed", b"\x6c\x1b\x00" + bytes(4))
    with pytest.raises(Exception, match="PLINK"):
        binary.plink(spark, str(tmp_path / "p"))[2].collect()


def test_taxonomy(spark, tmp_path):
    put(tmp_path / "nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsk\t|\n3\t|\t2\t|\tg\t|\n")
    put(tmp_path / "names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tB\t|\t\t|\tsynonym\t|\n2\t|\tBacteria\t|\t\t|\tscientific name\t|\n3\t|\tG\t|\t\t|\tscientific name\t|\n")
    put(tmp_path / "merged.dmp", "7\t|\t6\t|\n6\t|\t2\t|\n")
    nodes, merged = text.taxonomy(spark, str(tmp_path)), text.merged_taxa(spark, str(tmp_path))
    assert {r["tax_id"]: r["name"] for r in nodes.collect()} == {1: "root", 2: "Bacteria", 3: "G"}
    ids = spark.createDataFrame([(7,), (3,), (6,)], "tax_id int")
    assert {r["tax_id"]: r["current"] for r in science.resolve(ids, merged).collect()} == {7: 2, 3: 3, 6: 2}
    assert science.lowest_common_ancestor(nodes, spark.createDataFrame([(1, 2), (1, 3)], "grp int, tax_id int")).first()["lca"] == 2


def test_p_values_and_newick(spark, tmp_path):
    path = put(tmp_path / "p", "a\t.01\nb\t.02\nc\t.04\nd\t.10\ne\t.50\n")
    found = science.adjust(text.p_values(spark, path, 2), "BH").orderBy("ord").collect()
    assert [round(r["adjusted"], 4) for r in found] == [0.05, 0.05, 0.0667, 0.125, 0.5]
    with pytest.raises(Exception, match="no p-value"):
        text.p_values(spark, path, 1).collect()
    with pytest.raises(ValueError):
        science.adjust(text.p_values(spark, path, 2), "x")
    trees = text.newick(spark, put(tmp_path / "t", "(a:1,b)c;\n(x,(y,z));\n"))
    assert science.newick_nodes(trees).count() == 8


def test_split_files(spark, tmp_path):
    parts = sq.split_parts(text.fastq(spark, put(tmp_path / "r.fq", fastq_of(60))).drop("file"), per_part=25)
    assert sinks.write_split(parts, str(tmp_path / "split"), "{:04d}.r.fq") == ["0001.r.fq", "0002.r.fq", "0003.r.fq"]
    assert (tmp_path / "split" / "0003.r.fq").read_text() == "".join(x for x in fastq_of(60).split("@r50")[1:] for x in ["@r50" + x])


def test_tables(spark):
    df = spark.createDataFrame([("a", 1234567, 0.5), ("bcd", 7, 1234.25)], "name string, n long, share double")
    assert sinks.tabular(df) == "name\tn\tshare\na\t1234567\t0.50\nbcd\t7\t1234.25\n"
    assert sinks.pretty(df) == "name          n    share\na     1,234,567      0.5\nbcd           7  1,234.2\n"


def test_unsorted_rows_are_found(spark):
    rows = [(0, "a", 5), (1, "a", 9), (2, "a", 7), (3, "b", 1), (4, "a", 20), (5, "b", 0)]
    df = spark.createDataFrame([(o, c, s, s + 1) for o, c, s in rows], "ord long, chrom string, chrom_start long, chrom_end long")
    assert sorted((r["chrom"], r["ord"], r["problem"]) for r in iv.unsorted(df).collect()) == [("a", 2, "start"), ("a", 4, "chromosome"), ("b", 5, "chromosome"), ("b", 5, "start")]
    assert iv.unsorted(df.filter("ord in (0, 1, 3)")).count() == 0


def test_streaming(spark, tmp_path):
    from strandloom.streaming import reports

    rows = [(k, f"r{k}", "ACGT" * 10, ("I" if k % 2 else "!") * 40, f"2024-01-01 00:{k:02d}:00") for k in range(40)]
    df = spark.createDataFrame(rows, "ord long, id string, seq string, qual string, t string").selectExpr("ord", "id", "seq", "qual", "cast(t as timestamp) as arrived")
    df.filter("ord < 20").write.parquet(str(tmp_path / "in"))
    for more in (False, True):
        if more:
            df.filter("ord >= 20").write.mode("append").parquet(str(tmp_path / "in"))
        stream = reports.read_stream(spark, str(tmp_path / "in"))
        reports.write_table(reports.running_report(stream), str(tmp_path / "report"), str(tmp_path / "c1"), "complete").awaitTermination()
        row = spark.read.parquet(str(tmp_path / "report")).first()
        assert (row["reads_in"], row["reads_out"]) == ((40, 20) if more else (20, 10))
    stream = reports.read_stream(spark, str(tmp_path / "in"))
    reports.write_table(reports.windowed_counts(stream, late="0 minutes"), str(tmp_path / "w"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [10, 10, 10]


def test_several_files_are_told_apart(spark_small, tmp_path):
    """ord is one number over all files: the same record in two of them is two reads."""
    one, two = put(tmp_path / "a.fq", fastq_of(30)), put(tmp_path / "b.fq", fastq_of(30))
    mates = [put(tmp_path / f"{n}2.fq", fastq_of(30).replace(" x", " y")) for n in "ab"]
    reads, others = text.fastq(spark_small, [one, two]), text.fastq(spark_small, mates)
    assert sorted(r["ord"] for r in reads.collect()) == list(range(60))
    assert sq.pairs(reads, others).count() == 60
    kept = sq.dedup(reads, mode="full").collect()
    assert sorted((r["ord"], r["seq"]) for r in kept) == [(i, "ACGTN" * i) for i in range(7)]
    assert [r["ord"] for r in sq.head(reads, 35).collect()] == list(range(35))
    assert sorted((r["part"], r["ord"]) for r in sq.split_parts(reads, per_part=25).collect()) == [(i // 25, i) for i in range(60)]
    assert [r["id"].split()[0] for r in sq.interleave(reads, others).collect()] == [f"r{i % 30}" for i in range(60) for _ in range(2)]
    assert sorted(r["id"] for r in sq.rename(reads, "n").collect()) == sorted(f"n{i}" for i in range(60))


def test_several_fasta_and_bed_files(spark_small, tmp_path):
    paths = [put(tmp_path / f"{k}.fa", "".join(f">s{i}\n{'ACGT' * (i + 1)}\n" * 1 for i in range(9))) for k in range(3)]
    rows = sorted((r["ord"], r["id"], r["seq"]) for r in text.fasta(spark_small, paths).collect())
    assert rows == [(9 * k + i, f"s{i}", "ACGT" * (i + 1)) for k in range(3) for i in range(9)]
    bad = put(tmp_path / "bad.fa", "ACGT\n>x\nAC\n")
    with pytest.raises(Exception, match="text before the first header"):
        text.fasta(spark_small, [paths[0], bad]).collect()
    beds = [put(tmp_path / f"{k}.bed", "# c\nchr1\t1\t5\nchr2\t3\t9\n") for k in range(2)]
    assert sorted(r["ord"] for r in text.bed(spark_small, beds).collect()) == [1, 2, 4, 5]


def test_attributes_of_gtf_and_gff3(spark, tmp_path):
    lines = ['gene_id "G1"; transcript_id "T 1;x"; exon_number 3; tag "a"; tag "b";', "ID=e1;Name=a b", 'gene_id "G2"', "ID=q;Note=x y"]
    path = put(tmp_path / "a.gtf", "".join(f"c\ts\texon\t1\t9\t.\t+\t.\t{x}\n" for x in lines))
    found = [r["attribute_map"] for r in text.gff_attributes(text.gff(spark, path)).orderBy("ord").collect()]
    assert found == [{"gene_id": "G1", "transcript_id": "T 1;x", "exon_number": "3", "tag": "a"}, {"ID": "e1", "Name": "a b"}, {"gene_id": "G2"}, {"ID": "q", "Note": "x y"}]


def test_interval_predicates(spark):
    from pyspark.sql import functions as F

    rows = [(a, b, c, d) for a in range(4) for b in range(a, 5) for c in range(4) for d in range(c, 5)]
    args = [F.col(c) for c in "abcd"]
    for r in spark.createDataFrame(rows, "a int, b int, c int, d int").select("*", iv.overlaps(*args).alias("o"), iv.contains(*args).alias("k"), iv.overlap_bases(*args).alias("n")).collect():
        one, two = set(range(r["a"], r["b"])), set(range(r["c"], r["d"]))
        assert r["o"] == bool(one & two) and r["n"] == len(one & two) and r["k"] == (r["a"] <= r["c"] and r["d"] <= r["b"])


def test_info_and_calls_of_vcf(spark, tmp_path):
    path = put(tmp_path / "a.vcf", "##x\n#CHROM\nc\t1\t.\tA\tC\t.\tPASS\tDP=3;AF=0.5,0.1;DB;DP=4\tGT:DP\t0/1:9\t./.\nc\t2\t.\tA\tC\t7\tPASS\t.\n")
    df = text.vcf(spark, path)
    assert [r["info_map"] for r in text.vcf_info(df).orderBy("ord").collect()] == [{"DP": "3", "AF": "0.5,0.1", "DB": ""}, {}]
    assert [(r["ord"], r["sample"], r["call"]) for r in text.vcf_calls(df).orderBy("ord", "sample").collect()] == [(2, 0, {"GT": "0/1", "DP": "9"}), (2, 1, {"GT": "./."})]
