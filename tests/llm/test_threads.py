"""Operators of several threads in one session keep their own intermediate tables."""

import threading

from foliospark.llm import hmm, jaccard, suffixes
from foliospark.llm.shared import table
from foliospark.sources import scratch

SF = "/root/testdata/sf0.001"


def files(spark):
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch.shared_dir(spark))
    return {f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)}


def test_threads(spark):
    docs = table(spark, SF, "documents")
    asks = {
        "jaccard": lambda: jaccard.classes(docs, 3, 90, 100),
        "suffixes": lambda: suffixes.digests(suffixes.strip(docs)),
        "hmm": lambda: hmm.score(docs).select("doc_id", "n_tokens", "n_known"),
    }
    before, results, errors = files(spark), {}, []

    def ask(name, i):
        try:
            with scratch.scope(spark):
                results[name, i] = sorted(map(str, asks[name]().collect()))
        except Exception as e:  # noqa: BLE001
            errors.append((name, e))

    threads = [threading.Thread(target=ask, args=(name, i)) for i in range(2) for name in asks]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert all(results[name, 0] == results[name, 1] and len(results[name, 0]) == 200 for name in asks)
    assert files(spark) == before
