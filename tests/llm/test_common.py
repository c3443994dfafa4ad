import threading

from tidepool.llm.common import materialize, scratch


def test_scratch_of_two_threads(spark):
    """A table that one thread writes while another is within scratch() stays; kept ones go to the outer."""
    other, inside, written = [], threading.Event(), threading.Event()

    def write():
        inside.wait(60)
        other.append(materialize(spark.range(3), "other"))
        written.set()

    thread = threading.Thread(target=write)
    thread.start()
    with scratch() as keep:
        gone = materialize(spark.range(4), "gone")
        with scratch() as hold:
            kept = hold(materialize(spark.range(5), "kept"))
        keep(kept)
        inside.set()
        assert written.wait(60)
    thread.join()
    assert other[0].count() == 3 and kept.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(gone._written_to)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
