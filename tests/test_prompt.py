import io

from quiverlane.__main__ import Prompt


def test_prompt(spark, tmp_path):
    out = io.StringIO()
    p = Prompt(spark, out=out)
    (tmp_path / "q.txt").write_text("CREATE (:A {x: 1}); CREATE (:A {x: null});")
    for line in (".help", f".read {tmp_path / 'q.txt'}", "MATCH (n:A)", "RETURN n.x AS x ORDER BY x;", "RETURN 1 +;", ".nothing", f".open {tmp_path / 'graphs'}", "MATCH (n) RETURN count(*) AS n;"):
        assert p.line(line)
    assert not p.line(".quit")
    text = out.getvalue()
    assert "x\n----\n1\nnull\n" in text and "ParseError" in text and ".nothing is no command" in text and text.endswith("n\n-\n0\n")
