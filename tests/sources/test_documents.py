from quillstone.sources.documents import log_json, log_xml, read_json, read_xml, write_lines


def test_files(spark, tmp_path, capsys):
    df = spark.createDataFrame([('{"b":1,"a":[]}',), ("[1",)], "t string")
    write_lines(df, "t", str(tmp_path / "j"))
    rows = read_json(spark, str(tmp_path / "j")).collect()
    assert sorted((r.ok, r.canonical) for r in rows) == [(False, None), (True, '{"a":[],"b":1}')]
    (tmp_path / "x.xml").write_text("<a>\n<b/>\n</a>")
    (tmp_path / "y.json").write_text("{\n}")
    assert read_xml(spark, str(tmp_path / "x.xml")).first().printed == "<a><b/></a>" and read_json(spark, str(tmp_path / "y.json"), True).first().canonical == "{}"
    log_json(df.limit(1), "t", 2)
    log_xml(spark.createDataFrame([("<a><b/></a>",)], "t string"), "t", 2)
    assert capsys.readouterr().out == '{\n  "a": [],\n  "b": 1\n}\n<a>\n  <b/>\n</a>\n'
