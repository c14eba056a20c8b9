"""The README's first example runs as written (with a real path)."""

import os
import re

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_readme_example_runs(spark, capsys):
    code = re.search(r"```python\n(.*?)```", open(README, encoding="utf-8").read(), flags=re.S).group(1)
    code = code.replace(".../lineitem.parquet", "/root/testdata/sf0.001/lineitem.parquet")
    code = code.replace("spark = get_session()", "")
    env = {"spark": spark}
    exec(compile(code, "README.md", "exec"), env)
    assert env["out"]["priced"].count() > 0
    assert "net" in capsys.readouterr().out
