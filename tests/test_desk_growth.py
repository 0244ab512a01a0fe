"""Functions of the desk on long texts: their time grows with the text."""

from storyflow.operators import desk


def test_long_single_blocks_are_laid_out_in_time(spark):
    import time

    text = " ".join(f"Sentence number {i} is here." for i in range(12_000))
    df = spark.createDataFrame([(text,)], "t string").repartition(1)
    began = time.time()
    [row] = df.select(desk.laid_out("t").alias("b")).collect()
    parts = row.b.split("\n\n")
    assert len(parts) == 6000 and parts[0] == "Sentence number 0 is here. Sentence number 1 is here."
    assert time.time() - began < 15  # 6,000 times the whole text took minutes


def test_summaries_of_many_paragraphs_are_made_in_time(spark):
    import time

    text = "\n\n".join(["Share this page now.", "Too few words"] * 3000 + ["These opening words are said twice here, and they make a whole sentence."] * 2 + ["So the second paragraph has words enough, more than thirty with those of the first one, to end the summary right here at last."] + ["Never read at all, this one, since it comes too late for that."] * 3000)
    df = spark.createDataFrame([(text,)], "t string").repartition(1)
    began = time.time()
    [row] = df.select(desk.summary_from_body("t").alias("s")).collect()
    assert row.s == "These opening words are said twice here, and they make a whole sentence. So the second paragraph has words enough, more than thirty with those of the first one, to end the summary right here at last."
    assert time.time() - began < 15
