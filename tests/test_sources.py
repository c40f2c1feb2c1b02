import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tablescout.functions import files as fi
from tablescout.operators import profile as pr
from tablescout.sources import landed as la
from tablescout.sources import pages as pg
from tablescout.sources import payloads as pl
from tablescout.sources import tables as tb


def zipped(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, raw in members.items():
            z.writestr(name, raw)
    return buf.getvalue()


def test_archives():
    raw = zipped({"__MACOSX/x.csv": b"no", ".hid/y.csv": b"no", "b.json": b"[]", "d/a.CSV": b"p,q\n1,2"})
    assert fi.unpack("u.zip", raw) == ("d/a.CSV", b"p,q\n1,2", "")
    assert fi.unpack("u.csv.gz", gzip.compress(raw))[0] == "d/a.CSV"
    assert fi.unpack("u.zip", b"junk")[2] == "not a valid ZIP file"
    assert fi.unpack("u.zip", zipped({"a.md": b""}))[2] == "zip contains no tabular files"
    assert fi.unpack("u.gz", b"junk")[1] is None


def test_parsing():
    assert fi.parse("a.txt", b"a;b\n1;2")[:2] == (["a", "b"], [["1", "2"]])
    assert fi.parse("a.csv", "n,é\n1,ü".encode("latin-1"))[:2] == (["n", "é"], [["1", "ü"]])
    assert fi.parse("a.csv", b'a,b\n"x,y",2')[1] == [["x,y", "2"]]
    assert fi.parse("a", b"a\tb\n1,1\t2,2\n")[:2] == (["a", "b"], [["1,1", "2,2"]])
    doc = {"meta": {}, "empty": [], "rows": [{"a": 1}, {"a": None, "b": {"c": 2}}]}
    assert fi.parse("a.json", json.dumps(doc).encode())[:2] == (["a", "b"], [["1", None], [None, '{"c": 2}']])
    assert fi.parse("a.json", b'{"a": 1}')[2] == "could not parse as tabular data"


def test_landed_folder_to_wide_table(spark, tmp_path):
    (tmp_path / "f1").write_bytes(gzip.compress(b"code,year,v\nA,2020,1.5\nNA,2021,\n"))
    (tmp_path / "f2").write_bytes(b"one\n1\n")
    (tmp_path / "f3").write_bytes(b"x" * (11 * 1024 * 1024))
    urls = {"f1": "http://h/t.csv.gz", "f2": "http://h/u.csv", "f3": "http://h/v.csv"}
    rows = [(u, f"file:{tmp_path}/{f}", "text/csv", 200, (tmp_path / f).stat().st_size) for f, u in urls.items()]
    manifest = spark.createDataFrame(rows, "url string, path string, content_type string, status int, length bigint")
    cells = la.candidate_cells(la.landed_files(spark, str(tmp_path), manifest))
    status = {r["url"]: (r["usable"], r["error"]) for r in la.file_status(cells).collect()}
    assert status == {urls["f1"]: (True, ""), urls["f2"]: (False, "only 1 column(s)")}
    wide = la.wide(cells, urls["f1"])
    assert wide.dtypes == [("code", "string"), ("year", "bigint"), ("v", "double")]
    assert sorted(wide.collect(), key=lambda r: r["year"]) == [("A", 2020, 1.5), (None, 2021, None)]


def test_json_records(spark):
    docs = [('[{"a":1},{"a":2}]',), ('{"n":1,"e":[],"r":[{"a":3}]}',), ('{"a":4}',)]
    got = spark.createDataFrame(docs, "t string").select(
        tb.json_records(F.col("t")).alias("l"), tb.json_records(F.col("t"), strict=True).alias("s")).collect()
    assert [r["l"] for r in got] == [['{"a":1}', '{"a":2}'], [], ['{"a":4}']]
    assert [r["s"] for r in got] == [['{"a":1}', '{"a":2}'], ['{"a":3}'], None]


SEED = """country_code,country,year,score,note,flag
USA,United States,2020,1.5,NA,True
DEU,Germany,2020,2.5,,False
BRA,Brazil,2021,3.5,x,True
,Kenya,2021,100.0,y,False
USA,United States,2021,4.5,z,True
DEU,Germany,2022,5.5,w,False
"""


def test_seed_profile(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text(SEED)
    df = tb.with_row_position(tb.read_delimited(spark, str(path), infer=False))
    assert [r["country"] for r in df.orderBy("_pos").collect()][:4] == ["United States", "Germany", "Brazil", "Kenya"]
    df = tb.infer_types(df)
    sig = pr.signature(df, "seed.csv", pr.POS, file_format="CSV").first()
    types = {c["name"]: c["semantic_type"] for c in sig["columns"]}
    assert types == {"country_code": "identifier", "country": "entity", "year": "datetime", "score": "numeric",
                     "note": "categorical", "flag": "numeric"}
    assert sig["n_rows"] == 6 and sig["n_columns"] == 6
    assert sig["candidate_identifiers"] == ["country_code"]
    assert sig["candidate_composite_keys"] == []
    assert sig["entity_value_samples"]["country"] == ["United States", "Germany", "Brazil", "Kenya"]
    assert sig["quality_profile"]["high_missingness_columns"] == ["note"]
    assert sig["quality_profile"]["outlier_summary"]["score"]["outlier_count"] == 1
    assert sig["inferred_concepts"] == ["geospatial", "time_series"]
    columns = {c["name"]: c for c in sig["columns"]}
    assert (columns["year"]["min"], columns["year"]["max"]) == ("2020", "2022")
    assert columns["country_code"]["null_ratio"] == 0.1667


def test_connectors(spark):
    body = json.dumps({"result": {"results": [
        {"id": "", "name": "n", "title": None, "notes": None, "tags": ["plain", {"display_name": "d"}],
         "resources": [{"url": "u", "schema": {"fields": [{"name": "f"}, {"name": ""}]}}, {"url": None}]}]}})
    landed = spark.createDataFrame(
        [(1, "q", "P", "https://p.org", 200, None, body), (2, "q", "P", "https://p.org", 503, "down", None)],
        "query_id int, query string, source_name string, source_url string, status int, error string, body string")
    row = pl.ckan(landed).first()
    assert (row["dataset_id"], row["title"], row["description"], row["landing_page"]) == ("n", "n", "", "https://p.org/dataset/n")
    assert (row["keywords"], row["download_urls"], row["field_names"]) == (["plain", "d"], ["u"], ["f"])
    bad = pl.errors(landed, "CKAN").collect()
    assert [(r["query_id"], r["discovery_error"]) for r in bad] == [(2, "down")]


def test_page_search(spark):
    page = '<title>T &amp; U</title><script type="application/ld+json">{"@type":"Dataset","keywords":"a, b"}</script>'
    pages = spark.createDataFrame([("http://a/1", page), ("http://a/2", "<p>no</p>")], "url string, html string")
    html = '<a class="x" href="http://a/2">2</a> <a href="/rel">r</a> <a href=\'http://a/1\'>1</a> <a href="http://a/1">again</a>'
    found = pg.discover(spark.createDataFrame([(7, "q", html)], "query_id int, query string, html string"), pages).collect()
    assert [(r["query_id"], r["title"], r["dataset_id"], r["keywords"], r["pos"]) for r in found] == [
        (7, "T & U", "T & U", ["a", "b"], 1)]


def test_files_that_used_to_be_lost():
    import gzip
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tablescout.functions.files import cells_of, parse, unpack

    long = "x" * 200_000
    assert parse("a.csv", f'a,b\n"{long}",NA\n'.encode())[1] == [[long, None]]
    raw = b"a,b\n1,2\n"
    for _ in range(5):
        raw = gzip.compress(raw)
    assert unpack("a.csv" + ".gz" * 5, raw)[:2] == ("a.csv", b"a,b\n1,2\n")
    broken = bytearray(gzip.compress(b"a,b\n1,2\n" * 500))
    broken[12:40] = b"\xff" * 28
    assert unpack("a.csv.gz", bytes(broken))[2].startswith("decompression error")
    out = io.BytesIO()
    import datetime
    import decimal
    pq.write_table(pa.table({"d": [datetime.date(2020, 1, 2)], "m": [decimal.Decimal("1.50")], "b": [b"q"]}), out)
    assert [c[5] for c in cells_of("a.parquet", out.getvalue())][:2] == ["2020-01-02", "1.50"]
    assert parse("a.json", b'[{"iso":"NA","n":"1"}]')[1] == [["NA", "1"]]
    assert parse("a.xls", b"\xd0\xcf,\x11")[2] == "spreadsheets are not read"


def test_texts_that_look_like_json_stay(spark):
    rows = [("[DEPRECATED] Road data",), ("{x} notes",), ("[a b",), ('["a", ["b"]]',), (None,)]
    got = spark.createDataFrame(rows, "t string").select(
        pl.flat_text(F.col("t")).alias("f"), pl.json_list(F.col("t")).alias("l")).collect()
    assert [r["f"] for r in got] == ["[DEPRECATED] Road data", "{x} notes", "[a b", "a b", ""]
    assert [r["l"] for r in got][:3] == [["[DEPRECATED] Road data"], ["{x} notes"], ["[a b"]]
    assert got[4]["l"] == []


def test_nested_values_of_any_depth(spark):
    deep = "x"
    for i in range(12):
        deep = {"k": [deep, i]} if i % 2 else [deep, {"n": None, "e": [], "o": {}, 'q"': 'a \\" : [b', "s": "\\"}]
    rows = [(json.dumps(deep),), ('{"a": [1, 2.5, true, "", null], "b": "c:", "d\\\\": {"e": ["\\u00e9\\n"]}}',), ('{"a": [1}',)]

    def flat(v):
        if isinstance(v, (list, dict)):
            return " ".join(flat(x) for x in (v.values() if isinstance(v, dict) else v))
        return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    got = [r["f"] for r in spark.createDataFrame(rows, "t string").select(pl.flat_text(F.col("t")).alias("f")).collect()]
    assert got == [flat(json.loads(rows[0][0])), flat(json.loads(rows[1][0])), rows[2][0]]


def test_large_answers_are_read(spark):
    entries = [{"title": f"t{i}", "description": "x" * 1000} for i in range(40_000)]  # 40 MB, over the limit of a variant
    landed = spark.createDataFrame([(0, "P", "u", 200, None, json.dumps({"dataset": entries})), (1, "P", "u", 200, None, "[1]"), (2, "P", "u", None, None, '{"dataset": 3}')],
                                   "catalog_pos int, source_name string, source_url string, status int, error string, body string")
    assert pl.dcat_entries(landed).count() == 40_000
    bad = landed.withColumn("query_id", F.col("catalog_pos")).withColumn("query", F.lit("q"))
    assert [(r["query_id"], r["discovery_error"]) for r in pl.errors(bad, "DCAT").collect()] == [(1, "unreadable answer")]


def test_links_without_quotes_and_numbered_signs(spark):
    html = '<a href=http://a/1>1</a><a class=x href="http://a/?b=1&#38;c=&#x4E2D;&#0;&#xD800;&amp;#38;">2</a><A HREF=\'http://a/it"s\' >3</A><a href=/rel>'
    got = spark.createDataFrame([(html,)], "h string").select(pg.links(F.col("h")).alias("l")).first()["l"]
    assert got == ["http://a/1", "http://a/?b=1&c=中&#0;&#xD800;&#38;", 'http://a/it"s']


def _random_table(r):
    cell = "ab,\"\n;é \r"
    rows = [["".join(r.choice(cell) if r.random() < 0.6 else "x" for _ in range(r.randint(0, 12))) for _ in range(3)] for _ in range(r.randint(1, 30))]
    return [row if any(row) else ["z", "", ""] for row in rows]


@pytest.mark.parametrize("block", ["37b", "1k"])
def test_quoted_records_are_cut_by_many_tasks(spark, tmp_path, block):
    import csv
    import io
    import random

    from tablescout.sources import blocks

    r = random.Random(block)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for t in range(5):
            folder, want = tmp_path / str(t), []
            folder.mkdir()
            for f in range(r.randint(1, 3)):
                rows = _random_table(r)
                out = io.StringIO(newline="")
                csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows([["a", "b", "c"], *rows])
                text = out.getvalue()
                if r.random() < 0.5:
                    text += '5" pipe,x,y"z\n'
                    rows.append(['5" pipe', "x", 'y"z'])
                (folder / f"{f}.csv").write_bytes(text.encode())
                want += rows
            assert block != "37b" or blocks.fragments(spark, str(folder), "\n").rdd.getNumPartitions() > 3
            got = blocks.delimited_records(spark, str(folder), ",").orderBy("head", "pos").collect()
            assert all(x["value"] == "a,b,c" for x in got if x["head"])
            data = [x for x in got if not x["head"]]
            assert [x["pos"] for x in data] == list(range(len(want)))
            assert [next(csv.reader(io.StringIO(x["value"], newline=""))) for x in data] == want
            table = tb.read_delimited(spark, str(folder), infer=False, position="p").orderBy("p").collect()
            assert [[x["a"], x["b"], x["c"]] for x in table] == [[None if c == "" or c in tb.fv.NA_TOKENS else c for c in row] for row in want]
            assert [x["p"] for x in table] == list(range(len(want)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("block", ["37b", "1k"])
def test_json_elements_are_cut_by_many_tasks(spark, tmp_path, block):
    import random

    from tablescout.sources import blocks

    r = random.Random(block)

    def value(depth=0):
        k = r.random()
        if depth > 3 or k < 0.4:
            return r.choice([1, 2.5, None, True, 'a,"b', "\\", 'x\\"],[', "{", "é\n", "", '\\\\"'])
        if k < 0.7:
            return [value(depth + 1) for _ in range(r.randint(0, 4))]
        return {r.choice('abcd,"[{') * r.randint(1, 2): value(depth + 1) for _ in range(r.randint(0, 4))}

    def records(doc, strict):
        if isinstance(doc, list):
            return doc
        lists = [v for v in doc.values() if isinstance(v, list) and (v or not strict)]
        return lists[0] if lists else [] if strict else [doc]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for t in range(6):
            folder, strict, want = tmp_path / str(t), t % 2 == 1, []
            folder.mkdir()
            for f in range(r.randint(1, 3)):
                rows = [{"k": value()} for _ in range(r.randint(0, 20))]
                doc = r.choice([rows, {"n": 1, "m": {"z": [1]}, "e": [], "rows": [*rows, {"k": 1}], "o": [1, 2], "p": "x"}, {"a": 1, "b": {"c": [1, 2]}}])
                (folder / f"{f}.json").write_text(json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5))
                want += records(doc, strict)
            got = blocks.json_elements(spark, str(folder), strict).orderBy("pos").collect()
            assert [json.loads(x["value"]) for x in got] == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_json_columns_keep_their_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1, "rows": [{"z": 1, "b": "x"}, {"a": [1], "z": 2}]}')
    df = tb.read_json(spark, str(tmp_path / "a.json"), position="p")
    assert df.columns == ["z", "b", "a", "p"]
    assert [r["z"] for r in df.orderBy("p").collect()] == [1, 2]


ANSWERS = "query_id int, query string, source_name string, source_url string, status int, error string, body string"


def test_each_level_of_an_answer_is_parsed_once(spark):
    bodies = ['{"result": {"results": [null, {"id": "a"}, {"id": "b"}]}}', '{"result": {"results": []}}', '{"result": {"results": {}}}', "no"]
    landed = spark.createDataFrame([(i, "q", "P", "u", 200, None, b) for i, b in enumerate(bodies)], ANSWERS)
    # the checkpoint keeps the rows from being folded into the plan
    landed = landed.localCheckpoint()
    found = pl.ckan(landed, 2).select("query_id", "pos", "dataset_id")
    assert sorted(map(tuple, found.collect())) == [(0, 1, None), (0, 2, "a")]
    for df, levels in ((pl.ckan(landed), 2), (pl.datacite(landed), 1), (pl.dcat_entries(landed.withColumnRenamed("query_id", "catalog_pos")), 1)):
        plan = df.select("source_url", *[c for c in ("pos", "entry_pos") if c in df.columns])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(MapType") == levels, plan


def test_answers_are_made_by_many_tasks(spark, tmp_path):
    from tablescout.plans import source_queries as sq

    spark.range(9000).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet")
    landed = sq._answers(spark, str(tmp_path), sq.CKAN_ITEM, sq._CKAN_WRAP)
    assert len(landed.inputFiles()) == 3 and landed.count() == 9000


def test_archives_are_handed_on_in_frames_of_bounded_size():
    import pyarrow as pa

    from tablescout.plans.source_queries import packed

    body = "a,b\n" + "1,2\n" * 250_000
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(12)), "url": ["http://h/t.zip", "http://h/t.csv.gz"] * 6, "body": [body] * 12})
    files = list(packed([texts]))
    assert sum(f.num_rows for f in files) == 12 and max(f.nbytes for f in files) < fi.FRAME_BYTES + 2 * len(body)
    found = list(fi.unpacked(files))
    assert sum(f.num_rows for f in found) == 12 and max(f.nbytes for f in found) < fi.FRAME_BYTES + 2 * len(body)
    assert {(m, len(c), e) for f in found for m, c, e in zip(*(f.column(n).to_pylist() for n in ("member", "content", "error")))} == {
        ("data/a.csv", len(body), ""), ("http://h/t.csv", len(body), "")}
