"""Executors need no copy of the package: a session whose workers can't import it runs what carries objects to them."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's alone: it is not in the workers' environment
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from meshwright.llm import sentencepiece_codec, toxicity
def importable(batches):
    for pdf in batches:
        try:
            import meshwright
            pdf["found"] = True
        except ModuleNotFoundError:
            pdf["found"] = False
        yield pdf
assert not spark.range(1).toPandas().empty and not spark.range(1).mapInPandas(importable, "id long, found boolean").first().found
docs = spark.createDataFrame([(i, "some text " * (i % 5) + ("moron scum" if i % 4 == 0 else "kind words")) for i in range(40)], "doc_id long, text string")
labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
assert toxicity.score(docs, labels).count() == 40
import public_tokenizers
model = public_tokenizers.path("piece_bpe_32k.model")
rows = sentencepiece_codec.encoded(docs, model).persist()
assert rows.where("round_trip").count() == 40
assert {{r.text for r in sentencepiece_codec.decoded(rows, model).collect()}} == {{r.text for r in docs.collect()}}
spark.stop()
print("done")
"""


def test_workers_without_the_package(tmp_path):
    root = str(Path(__file__).parents[2])
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=root, shared=f"file://{tmp_path}/shared"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != Path(root)]
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env | {"PYTHONPATH": ":".join(paths)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "done" in done.stdout, done.stderr[-2000:]
