"""CSV files of mixed headers and encodings, against Python's csv module."""

import csv
import io

import pytest

from tallyvox.sources import csv_files, sync, uploads

FILES = {
    "a.csv": ("Review ID,Rating,Review Text\r\n1,5,good thing\r\n2,,\"two\nlines, \"\"quoted\"\"\"\r\n", "utf-8"),
    "b.csv": ("Review Text,Review ID,Rating\nbad thing,3,2\ncafé,4,1\n", "utf-8"),
    "c.csv": ("Rating,Review ID,Review Text,Extra\n3,5,caf\xe9 \xfcber,x\n", "latin-1"),
    "d.csv": ("﻿\"Review ID\",\"Review\nText\",,Rating\n6,named oddly,blank name,4\n", "utf-8"),
    "e [1].csv": ("Review ID,Rating,Review Text\n7,1,short name\n", "utf-8"),
    "short.csv": ("Review ID,Rating,Review Text\n8,2\n9,3,full,too,many\n", "utf-8"),
    "header only.csv": ("Review ID,Colour\n", "utf-8"),
    "empty.csv": ("", "utf-8"),
    "twice.csv": ("Review ID,rating,Rating,Review Text\n10,,4,x\n11,2,5,y\n", "utf-8"),
}


def by_csv(names):
    """The rows by csv.reader: blank fields are null, names are compared without case."""
    out = []
    for name in names:
        text, encoding = FILES[name]
        records = list(csv.reader(io.StringIO(text.encode(encoding).decode(encoding).removeprefix("﻿"), newline="")))
        if not records:
            continue
        head = [h.strip() or f"Unnamed: {i}" for i, h in enumerate(records[0])]
        for record in records[1:]:
            row = {}
            for h, v in zip(head, record):
                if v and not row.get(h.lower()):
                    row[h.lower()] = v
            out.append({"source_file": name, **row})
    return sorted(out, key=lambda r: (r["source_file"], r["review id"]))


@pytest.fixture
def folder(tmp_path):
    for name, (text, encoding) in FILES.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    return tmp_path


def test_each_file_by_its_own_header_and_encoding(spark, folder):
    rows = csv_files.read_csv_files(spark, str(folder))
    got = [{k.lower(): v for k, v in r.asDict().items() if v is not None and k != "_ord"} for r in rows.collect()]
    assert sorted(got, key=lambda r: (r["source_file"], r["review id"])) == by_csv(FILES)
    assert {"Extra", "Colour", "Unnamed: 2", "Review\nText"} <= set(rows.columns)
    assert [r["Review ID"] for r in rows.where("source_file = 'a.csv'").orderBy("_ord").collect()] == ["1", "2"]
    assert rows.select("_ord").distinct().count() == 11
    odd = {(r["source_file"], r["n_columns"], r["record"]) for r in csv_files.odd_records(spark, str(folder)).collect()}
    assert odd == {("short.csv", 3, "8,2"), ("short.csv", 3, "9,3,full,too,many")}


def test_layouts_are_shared_by_equal_files(spark, folder):
    found = csv_files.layouts(spark, str(folder))
    assert len(found) == 6
    plain = csv_files.Layout("UTF-8", ("Review ID", "Rating", "Review Text"))
    assert [p.rsplit("/", 1)[-1] for p in found[plain]] == ["a.csv", "e [1].csv", "short.csv"]
    forced = csv_files.read_csv_files(spark, str(folder / "b.csv"), "ISO-8859-1")
    assert "cafÃ©" in {r["Review Text"] for r in forced.collect()}


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert csv_files.read_csv_files(spark, str(tmp_path)).count() == csv_files.odd_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "y.csv").write_text("\n".join(["\"a", *["b"] * 100, "c\",d", "1,2"]))
    with pytest.raises(ValueError, match="header"):
        csv_files.read_csv_files(spark, str(tmp_path))


def test_headers_in_other_orders_reach_the_synced_tables(spark, tmp_path):
    reviews, catalogs, out = (tmp_path / x for x in ("reviews", "catalogs", "out"))
    reviews.mkdir(), catalogs.mkdir()
    (reviews / "a.csv").write_bytes("Review ID,Rating,Review Text,Product ID\n1,5,caf\xe9,S1\n".encode("latin-1"))
    (reviews / "b.csv").write_text("Review Text,Product ID,Review ID,Rating\nolé,S2,2,4\n")
    (catalogs / "a.csv").write_text("SKU,Master Item,Brand\nS1,M1,B1\n")
    (catalogs / "b.csv").write_text("Brand,SKU\nB2,S2\n")
    sync.sync_reviews(spark, str(reviews), str(catalogs), str(out))
    got = {(r["review_id"], r["review_text"], r["rating"], r["mapped_brand"], r["match_type"]) for r in sync.read_synced(spark, str(out), "reviews").collect()}
    assert got == {("1", "café", 5.0, "B1", "product_to_sku"), ("2", "olé", 4.0, "B2", "product_to_sku")}
    assert uploads.normalize_reviews(uploads.read_review_csv(spark, str(reviews / "b.csv")).drop("_ord")).first()["review_text"] == "olé"
