"""What a job leaves on disk while it runs."""

import os
import time

from corvane.llm import linededup, shared
from corvane.session import keep, shared_dir


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def tables(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return {x.rsplit("-", 1)[0] for x in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_shuffles_go_with_the_query_that_made_them(spark):
    before = shuffle_files(spark)
    rows = [keep(spark.range(1000).groupBy("id").count(), "counts"), shared.stage(spark.range(1000).repartition(3, "id"), "dealt")]
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert [x.count() for x in rows] == [1000, 1000]


def test_lines_leave_one_table(spark):
    line = "the quick brown fox number {} jumps over the lazy dog and then over all the other dogs of the yard"
    docs = spark.createDataFrame([(i, "\n".join(line.format(k) for k in range(i, i + 8))) for i in range(40)], "doc_id long, text string")
    shared.release(spark)
    assert linededup.removed_lines(docs).count() == 40
    assert tables(spark) == {"removed"}
