"""run() against brute force, and the rules that the driver's environment sets."""

import subprocess
import sys

import pytest

import corpus_pipeline
from cuesheet.llm import langid
from cuesheet.llm.runtime import shared_dir
from tests.conftest import SMALL
from tests.llm.common import LOW, contamination, similar

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(docs, "lang", "text", "doc_id")
    text = {r.doc_id: r.text for r in docs.collect()}
    stay = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    first = {}
    for i in sorted(stay):
        first.setdefault(text[i].translate(LOW), i)
    stay = set(first.values())
    group = similar({i: text[i] for i in stay})
    stay = {i for i in stay if group[i] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    clean = set()
    for i in stay:
        n, hit, _ = contamination(text[i], items)
        if not (hit and 20 * hit >= n):
            clean.add(i)
    from tokenizers import Tokenizer

    order = sorted(clean)
    counts = [len(e.ids) for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([text[i] for i in order], add_special_tokens=False)]
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == dict(zip(order, counts))
    assert (out.groupby("bin_id")["n_tokens"].sum() <= out.groupby("bin_id")["bin_capacity"].first()).all()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_without_the_optional_folders(tmp_path):
    import os
    import shutil

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("cuesheet", "tests", "__spark_entry__.py", "bench.py"):
        src = os.path.join(repo, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "cuesheet" / "llm")
    shutil.rmtree(tmp_path / "tests" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'seg_islands' in q and 'pipeline' not in q and not any(k.startswith('op') and '_' in k and k[2:3].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    # What is left is collected whole, and the tests of functions, sources and entry points are run.
    run = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    subprocess.run([*run, "--collect-only", "tests"], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, stdout=subprocess.DEVNULL)
    subprocess.run([*run, "tests/test_functions.py", "tests/test_io.py", "tests/test_oracle.py::test_entry"], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, stdout=subprocess.DEVNULL)


def test_a_missing_dependency_is_an_error(tmp_path):
    import os
    import shutil

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(repo, "cuesheet"), tmp_path / "cuesheet")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(repo, name), tmp_path / name)
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode and "not here" in done.stderr


def test_shared_folder_is_the_session_setting(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == given if given else shared_dir(spark).startswith("file:")

    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: "hdfs://x/shared/")

    assert shared_dir(Fake) == "hdfs://x/shared"

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Bare)
