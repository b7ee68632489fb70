"""What the pair operators shuffle: a row goes to a bounded number of tasks, not to every block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import clusters, embedding, mixed

ROWS, LENGTH = 1600, 16


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def frame(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(mixed, "BLOCK", 16)
    x = np.random.default_rng(4).normal(size=(ROWS, LENGTH))
    monkeypatch.setattr(mixed, "SPREAD", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to broadcast
    yield spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(x)], "id long, v array<double>, label int").repartition(4)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


VIEWS = {"one": (0.6, list(range(8))), "two": (0.4, list(range(8, 16)))}
JOBS = {
    "hybrid_similarity": (40, lambda f: clusters.candidates(f, "id", "v", 5)),
    "density_outliers": (32, lambda f: clusters.local_density(f, "id", "v", "label")),
    "cosine_pairs": (12, lambda f: clusters.pair_summary(f, "id", "v")),
    "silhouette_exact": (12, lambda f: clusters.silhouette(f, "id", "v", "label")),
    "embedding_outliers": (16, lambda f: clusters.local_outlier_factor(f, "id", "v", 5)),
    "embedding_neighbours": (12, lambda f: embedding.view_candidates(f.select("id", F.slice("v", 1, 8).alias("one"), F.slice("v", 9, 8).alias("two")), "id", {"one": 0.6, "two": 0.4}, 5)),
    "cluster_choice": (120, lambda f: mixed.choose(mixed.mixed_frame(f, "id", "v", VIEWS), 2, 3).rows),
    "kmedoids": (17, lambda f: clusters.kmedoids(f, "id", "v", 4, rounds=3)),
    "embedding_clusters": (38, lambda f: embedding.embedding_clusters(f, "id", "v", 3, 4, tries=2)[0]),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_rows_go_to_few_tasks(spark, frame, name):
    """100 blocks, shared by four tasks; the limit is in times the size of the vectors."""
    times, job = JOBS[name]
    before = shuffled(spark)
    job(frame).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < times * ROWS * LENGTH * 8
