"""Readers on small literal files, and round trips of writers."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.sources import tables, text_blocks, xml
from massif.streaming import events as E


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    return write


def test_mgf(spark, put):
    text = "BEGIN IONS\nTITLE=first scan=7\nPEPMASS=500.25 1000\nCHARGE=2+\nRTINSECONDS=120\nSCANS=7\n100.1 5\n200.2 6.5\nEND IONS\nBEGIN IONS\nTITLE=x scan=8\nPEPMASS=300\nCHARGE=1-\n50.5 1\nEND IONS\nBEGIN IONS\nSCANS=7\nPEPMASS=1\nEND IONS\n"
    out = {r.scan: r for r in text_blocks.read_mgf(spark, put("a.mgf", text)).collect()}
    assert set(out) == {7, 8}
    assert out[8].charge == -1 and out[8].mz == [50.5]


def test_fasta(spark, put):
    text = ">sp|P1|NAME_HUMAN A protein OS=Homo sapiens OX=9606 GN=ABC PE=1\nMKR\nPEP\n>plain other\nAAA\n>plain again\nCCC\n>empty\n"
    out = {r.accession: r for r in text_blocks.read_fasta(spark, put("a.fasta", text)).collect()}
    assert set(out) == {"P1", "plain", "plain_2"}
    assert (out["P1"].sequence, out["P1"].organism, out["P1"].gene, out["P1"].name) == ("MKRPEP", "Homo sapiens", "ABC", "NAME_HUMAN")


def test_msp_and_msalign(spark, put):
    msp = "Name: PEPTIDE/2\nMW: 799.3\nComment: iRT=12.5\nNum peaks: 2\n100.1\t5\t\"b1/0ppm\"\n200.2\t6\t\"y1/0ppm\"\n\nName: AAA/1\nNum peaks: 1\n50\t1\t\"b2\"\n"
    out = {r.name: r for r in text_blocks.read_msp(spark, put("a.msp", msp)).collect()}
    assert out["PEPTIDE/2"].charge == 2 and out["PEPTIDE/2"].rt == 12.5 and [p.annotation for p in out["PEPTIDE/2"].peaks] == ["b1", "y1"]
    align = "BEGIN IONS\nSCANS=3\nRETENTION_TIME=60\nLEVEL=2\nPRECURSOR_MASS=1000.5\nPRECURSOR_CHARGE=3\n500.1\t10\t2\nEND IONS\n"
    row = text_blocks.read_msalign(spark, put("b.msalign", align)).first()
    assert (row.scan, row.level, row.precursor_charge, row.peaks[0].charge) == (3, 2, 3, 2)


def test_ptm_list_and_obo(spark, put):
    ptm = "ID   Phospho\nAC   X1\nTG   S.\nPP   Anywhere.\nCF   H1O3P1\nMM   79.966\nKW   A.\nKW   B.\n//\nID   Broken\nTG   K.\n//\n"
    out = {r.id: r for r in text_blocks.read_ptm_list(spark, put("p.txt", ptm)).collect()}
    assert out["Phospho"].mass == 79.966 and out["Phospho"].keywords == ["A", "B"] and out["Phospho"].problem is None
    assert out["Broken"].problem == "neither mass nor formula"
    obo = "format: 1\n\n[Term]\nid: MS:1\nname: a term\nis_a: MS:0 ! root\n\n[Term]\nid: MS:2\nname: old\nis_obsolete: true\n"
    terms = {r.id: r for r in text_blocks.read_obo(spark, put("o.obo", obo)).collect()}
    assert terms["MS:1"].is_a == ["MS:0"] and terms["MS:2"].obsolete


def test_psm_table(spark, put):
    text = "File Name\tScan Number\tBase Sequence\tFull Sequence\tQValue\t126\t127\nf\t5\tPEP\tPEP[x]\t0.01\t1.5\t\nf\tbad\tPEP\tPEP\t0.02\t\t\nf\t6\tAAA\tAAA\t0.5\t\t\n"
    good, bad = tables.read_psm_tsv(spark, put("a.psmtsv", text), {"QValue": "cast(QValue as double) < 0.4"})
    rows = good.collect()
    assert [r.scan for r in rows] == [5] and rows[0].reporter_ions == [1.5, None] and bad.count() == 1
    assert tables.sniff("a\tb") is None


def test_matched_ions(spark):
    row = spark.createDataFrame([("[b2+1:199.1, y1+2:175.1];[c1-17.0+1:88.5]",)], "s string").select(tables.parse_matched_ions(F.col("s")).alias("i")).first()
    assert [(i.ion, i.number, i.charge, i.mz) for i in row.i] == [("b", 2, 1, 199.1), ("y", 1, 2, 175.1), ("c", 1, 1, 88.5)]


def test_terminating_filter_and_fill(spark):
    df = spark.createDataFrame([(i, i < 4) for i in range(8)], "i int, ok boolean")
    assert sorted(r.i for r in tables.until_first_failure(df, "i", F.col("ok")).collect()) == [0, 1, 2, 3]
    alt = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "o int, id string")
    assert [r.owner for r in tables.fill_alternatives(alt, "o", "id").orderBy("o").collect()] == ["a", "a", "b", "b"]


def test_sdrf(spark, put):
    a = tables.read_sdrf(spark, put("a.sdrf.tsv", "﻿Source Name\tComment[x]\tComment[x]\r\ns1\t1\t2\r\ns2\t3\r\n"))
    assert {(r.row, r.name, r.value) for r in a.collect()} == {(0, "source name", "s1"), (0, "comment[x]", "1"), (0, "comment[x]", "2"), (1, "source name", "s2"), (1, "comment[x]", "3")}
    b = tables.read_sdrf(spark, put("b.sdrf.tsv", "Source Name\tTissue\ns9\tliver\n"))
    merged = tables.merge_sdrf(a, b).collect()
    assert len(merged) == 3 * 4 and sum(r.value == "not available" for r in merged) == 5
    wide = tables.build_sdrf(b.select("row", "name", "value"), ["source name", "tissue", "age"]).first()
    assert wide["age"] == "not available" and wide["tissue"] == "liver"


def spectrum(index, level, mz, wide=True, packed=True, extra=""):
    raw = np.asarray(mz, "<f8" if wide else "<f4").tobytes()
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    kind = '<cvParam accession="MS:1000523" name="64-bit float"/>' if wide else ""
    pack = '<cvParam accession="MS:1000574" name="zlib"/>' if packed else ""
    arrays = "".join(f'<binaryDataArray>{kind}{pack}<cvParam accession="{a}" name="x"/><binary>{text}</binary></binaryDataArray>' for a in ("MS:1000514", "MS:1000515"))
    return f'<spectrum index="{index}" id="scan={index + 1}"><cvParam accession="MS:1000511" name="ms level" value="{level}"/><scanList><scan><cvParam accession="MS:1000016" name="t" value="{index}.5"/></scan></scanList>{extra}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'


def test_mzml_and_round_trip(spark, put, tmp_path):
    ion = '<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" name="m" value="400.5"/><cvParam accession="MS:1000041" name="z" value="2"/></selectedIon></selectedIonList></precursor></precursorList>'
    text = "<mzML><run><spectrumList>" + spectrum(0, 1, [100.0, 200.0]) + spectrum(1, 2, [50.5], wide=False, packed=False, extra=ion) + spectrum(2, 2, [], extra=ion) + "</spectrumList></run></mzML>"
    df = xml.read_mzml(spark, put("a.mzML", text))
    rows = df.orderBy("scan").collect()
    assert [r.scan for r in rows] == [1, 2, 3] and rows[0].mz == [100.0, 200.0] and rows[1].mz == [50.5] and rows[2].mz == []
    assert rows[1].precursor_scan == 1 and rows[1].precursor_mz == 400.5 and rows[1].charge == 2 and rows[1].rt_min == 1.5
    xml.write_mzml(df, str(tmp_path / "out"))
    again = xml.read_mzml(spark, str(tmp_path / "out")).orderBy("scan").collect()
    assert [(r.scan, r.ms_level, r.precursor_scan, r.mz, r.intensity) for r in again] == [(r.scan, r.ms_level, r.precursor_scan, r.mz, r.intensity) for r in rows]


def test_other_xml(spark, put):
    uniprot = '<uniprot><entry><accession>P1</accession><accession>P2</accession><name>N</name><gene><name type="primary">G</name></gene><organism><name type="scientific">O</name></organism><feature type="modified residue" description="Phospho"><location><position position="3"/></location></feature><feature type="sequence variant"><original>A</original><variation>T</variation><location><begin position="4"/><end position="5"/></location></feature><sequence length="6">MKR\nPEP</sequence></entry></uniprot>'
    row = xml.read_uniprot_xml(spark, put("u.xml", uniprot)).first()
    assert (row.accession, row.gene, row.organism, row.sequence) == ("P1", "G", "O", "MKRPEP")
    assert row.features[0].position == 3 and row.features[1].variation == "T" and row.features[1].end == 5
    mzid = '<m><SpectrumIdentificationResult spectrumID="scan=4"><SpectrumIdentificationItem peptide_ref="p" rank="1" chargeState="2" experimentalMassToCharge="500.5" calculatedMassToCharge="500.4" passThreshold="true"/></SpectrumIdentificationResult></m>'
    assert xml.read_mzidentml(spark, put("m.mzid", mzid)).first().charge == 2


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = E.read_stream(spark, folder, batch.schema)
    batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(E.run_to_memory(E.sliding_counts(stream), "sliding").collect()) == sorted(E.sliding_counts(batch).collect())
    assert E.gap_sessions(batch).agg(F.sum("n")).first()[0] == batch.count()
    q = E.gap_sessions(stream).writeStream.outputMode("append").format("memory").queryName("gaps").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("gaps").count() <= E.gap_sessions(batch).count()
