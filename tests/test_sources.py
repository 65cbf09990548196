from quern.sources import datasource, files


def test_directory_format(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    (tmp_path / "c.bin").write_text("x")
    datasource.register(spark)
    got = {r.name: r.text for r in spark.read.format("quern_directory").load(str(tmp_path)).collect()}
    assert got == {"a.md": "# A", "b.txt": None}
    only = spark.read.format("quern_directory").option("include", ".bin").load(str(tmp_path)).collect()
    assert [r.name for r in only] == ["c.bin"]
    assert spark.read.format("quern_directory").load(str(tmp_path / "a.md")).first().text == "# A"


def test_walk_skips_environments_and_secrets(tmp_path):
    for p in ("x/pyvenv.cfg", "x/m.py", "node_modules/n.js", "pkg.egg-info/i.py", "yarn.lock", "id_rsa", "ok.py", "secrets.md", "service-account-x.json", "pnpm-lock.yaml"):
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_text("1")
    names, left = files.walk(str(tmp_path))
    assert names == ["ok.py", "secrets.md"] and left == {"filtered": 2, "secrets_skipped": 2}
