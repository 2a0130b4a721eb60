"""The driver contract in a plain session started outside the repository:
Python workers there cannot import this package, so anything shipped to them
(the title-case pandas UDF) must travel by value."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_udf_queries_in_plain_session(tmp_path):
    script = textwrap.dedent(f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, '__spark_entry__.py')!r})
        E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        assert E.entry(spark).count() > 0
        q = E.queries()
        assert q["title_documents"](spark, "/root/testdata/sf0.001").count() > 0
        assert q["clean_claims"](spark, "/root/testdata/sf0.001").count() > 0
        print("OK")
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "OK" in out.stdout
