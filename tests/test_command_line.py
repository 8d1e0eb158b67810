"""The command line, in the test's own session."""

from loomstate import __main__ as cli
from loomstate.sources import frames


def test_verbs(spark, capsys, tmp_path):
    assert cli.main([]) == 0 and "inspect PATH" in capsys.readouterr().out
    assert cli.main(["run", "5"]) == 0 and "1\tcounter\t5\n1 values" in capsys.readouterr().out
    assert cli.main(["demo"]) == 0
    out = capsys.readouterr().out
    assert "committed" in out and "rejected" in out
    assert cli.main(["explore", "4", "lowest_score"]) == 0
    assert cli.main(["effects"]) == 0 and "waiting" in capsys.readouterr().out
    log = bytes(frames.write_logs(spark.createDataFrame([(1, 0, b"abc")], "l long, s long, p binary"), "l", "s", "p").first()["log"])
    (tmp_path / "x.log").write_bytes(log + b"torn")
    assert cli.main(["inspect", str(tmp_path / "x.log")]) == 0
    out = capsys.readouterr().out
    assert "1 frames" in out and "\t11\t4\n1 logs" in out


def test_refusals(capsys):
    assert cli.main(["no"]) == 2 and cli.main(["run", "x"]) == 1 and cli.main(["run", "0"]) == 1 and cli.main(["inspect"]) == 1 and cli.main(["demo", "1"]) == 1 and cli.main(["explore", "2", "best"]) == 1
