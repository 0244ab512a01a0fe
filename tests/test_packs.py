"""Story packs: two-phase commit of a data source."""

import json
import os

import pytest

from storyflow.sources import packs

STORY = "pos long, title string, source string, url string, published string, category string, tags array<string>, image_url string, image_caption string, image_credit string, image_alt string, website string, facebook string, newsletter string"
ROWS = [
    (1, "Council's “new” plan", "The Source", "https://x/1", "2024-01-01", "Politics", ["a", "b"], "https://x/i.jpg", "A cap", " Jane Roe ", "alt", "Copy", "Post", " Letter by JANE ROE "),
    (2, None, None, None, None, None, None, None, None, None, None, "", None, "x"),
    (3, "é!", "S", "u", "", "", [], "", "", "", "", "a", "b", "c"),
]


def files(spark, folder):
    out = {}
    for r in packs.read_packs(spark, folder).collect():
        out.setdefault(r["name"], {})[r["file"]] = r["text"]
    return out


def write(spark, folder, rows=ROWS, mode="append", parts=3):
    spark.dataSource.register(packs.StoryPacks)
    packs.packs(spark.createDataFrame(rows, STORY)).repartition(parts, "name").write.format("story_packs").mode(mode).save(folder)


def test_packs_hold_their_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    write(spark, folder)
    got = files(spark, folder)
    assert set(got) == {"council-s-new-plan-1", "story-2", "story-3"}
    one = got["council-s-new-plan-1"]
    assert set(one) == set(packs.FILES.values())
    assert one["website-article.txt"] == "Copy\n\nImage credit: Jane Roe" and one["facebook-post.txt"] == "Post\n\n📷 Image: Jane Roe" and one["newsletter-copy.txt"] == "Letter by JANE ROE"
    meta = json.loads(one["metadata.json"])
    assert meta["title"] == "Council's “new” plan" and meta["image"]["credit"] == "Jane Roe" and meta["tags"] == ["a", "b"]
    assert got["story-2"]["website-article.txt"] == "" and json.loads(got["story-2"]["metadata.json"])["image"]["credit"] == "Newsroom"
    write(spark, folder, ROWS[:1])
    assert len(os.listdir(folder)) == 2 and all(n.startswith("job-") for n in os.listdir(folder))
    write(spark, folder, ROWS[1:], mode="overwrite")
    assert len(os.listdir(folder)) == 1 and set(files(spark, folder)) == {"story-2", "story-3"}


def test_an_attempt_that_was_run_twice_leaves_one_pack(tmp_path):
    writer = packs.PackWriter(str(tmp_path), overwrite=False)
    row = {"name": "n", **dict.fromkeys(packs.FILES, ""), "website": "w"}
    lost = writer.write(iter([row]))  # an executor died after this one had written
    kept = writer.write(iter([row]))
    assert lost.folder != kept.folder
    writer.commit([kept, None, writer.write(iter([]))])
    (job,) = os.listdir(tmp_path)
    assert sorted(os.listdir(tmp_path / job)) == ["_SUCCESS", "part-00000"] and os.listdir(tmp_path / job / "part-00000") == ["n.zip"]
    assert json.loads((tmp_path / job / "_SUCCESS").read_text()) == {"packs": 1, "parts": 1}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    writer = packs.PackWriter(str(tmp_path), overwrite=True)
    writer.write(iter([{"name": "n", **dict.fromkeys(packs.FILES, "")}]))
    writer.abort([None])
    assert os.listdir(tmp_path) == []
    spark.dataSource.register(packs.StoryPacks)
    bad = packs.packs(spark.createDataFrame(ROWS, STORY)).selectExpr("name", "website", "facebook", "newsletter", "image_details", "source_link", "if(name = 'story-2', '{', metadata) AS metadata")
    with pytest.raises(Exception, match="JSON|Expecting"):
        bad.repartition(3, "name").write.format("story_packs").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_pack_is_the_same_bytes_each_time():
    row = {"name": "n", **dict.fromkeys(packs.FILES, "x"), "metadata": '{"a":"é"}'}
    assert packs.zipped(row) == packs.zipped(row)


def test_the_driver_lists_the_folders_of_tasks_alone(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    spark.dataSource.register(packs.StoryPacks)
    rows = [(f"s-{i}", *["t"] * 5, "{}") for i in range(300)]
    spark.createDataFrame(rows, packs.PACK).repartition(3).write.format("story_packs").mode("append").save(str(tmp_path / "p"))
    found, selector = [], fs.FileSelector
    monkeypatch.setattr(fs, "FileSelector", lambda at, **options: (found.append(at), selector(at, **options))[1])
    read = packs.read_packs(spark, str(tmp_path / "p"))
    assert found and all("/part-" not in at for at in found)
    assert not read.inputFiles()  # Spark's own listing would hold every pack
    assert {r.name for r in read.collect()} == {r[0] for r in rows} and read.count() == 300 * 6
