"""The command line: statements of files, dumps and dry runs."""

import io

from sparrowmill.__main__ import main


def run(spark, sf, tmp_path, text, *flags):
    p = tmp_path / "s.sql"
    p.write_text(text)
    out = io.StringIO()
    code = main(["--table", f"region={sf}/region.parquet", "--table", f"nation={sf}/nation.parquet", *flags, str(p)], spark, out)
    return code, out.getvalue().splitlines()


JOIN = "SELECT r_name, COUNT(*) AS n FROM region, nation WHERE r_regionkey = n_regionkey GROUP BY r_name ORDER BY r_name LIMIT 2;"


def test_statements_and_results(spark, sf, tmp_path):
    code, got = run(spark, sf, tmp_path, 'SELECT 1, "a"; ' + JOIN, "--statistics", "--echo", "--plan-enumerator", "DPccp")
    assert code == 0
    assert got[:3] == ["-- Select", '1,"a"', "-- 1 rows"] and got[4] == '"AFRICA",5' and got[-1] == "-- 2 rows"
    code, got = run(spark, sf, tmp_path, "CREATE DATABASE x; USE x; CREATE TABLE t (a INT(4)); INSERT INTO t VALUES (1), (2); SELECT COUNT(*) FROM t;", "--times")
    assert code == 0 and "2" in got and sum(x.startswith("-- ") for x in got) == 5


def test_quiet_and_dry_runs(spark, sf, tmp_path):
    assert run(spark, sf, tmp_path, "SELECT * FROM region;", "-q", "-s") == (0, ["-- 5 rows"])
    assert run(spark, sf, tmp_path, JOIN, "--dryrun") == (0, [])


def test_dumps(spark, sf, tmp_path):
    code, got = run(spark, sf, tmp_path, JOIN, "--dryrun", "--ast")
    text = "\n".join(got)
    assert code == 0 and got[0].startswith("Select") and "COUNT" in text and "r_regionkey" in text and any(x.startswith("  ") for x in got)
    for flag, word in (("--astdot", "digraph {"), ("--graph", "joins"), ("--graphdot", "--"), ("--graph2sql", "INNER JOIN"), ("--plan", "Optimized Logical Plan"), ("--plandot", "Join Inner"), ("--physplan", "Scan parquet")):
        code, got = run(spark, sf, tmp_path, JOIN, "--dryrun", flag)
        assert code == 0 and word in "\n".join(got), flag
    dot = "\n".join(run(spark, sf, tmp_path, 'SELECT "a\\"b" FROM region;', "--dryrun", "--astdot")[1])
    assert dot.count("{") == 1 and dot.count("->") == dot.count("label=") - 1


def test_errors(spark, sf, tmp_path, capsys):
    code, got = run(spark, sf, tmp_path, "SELECT 1; SELECT zz FROM region; SELECT 2;")
    assert (code, got) == (1, ["1"]) and "zz" in capsys.readouterr().err
    assert main([str(tmp_path / "none.sql")], spark, io.StringIO()) == 1
