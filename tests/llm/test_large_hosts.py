import pytest
from corpusdeck.llm import pages

SAME = "Read all of our other fine stories here today"


def host(spark, count=60, parts=5):
    """Boilerplate on three pages, another run on two, an exact repeat of a page, and an article that quotes."""
    made = []
    for k in range(count):
        more = f"<div>{SAME}</div>" * (k in (1, 20, 40)) + "<div>only two pages have this long line</div>" * (k in (2, 21))
        made.append((k, f"http://large/{k}", f"<div>story number{k} tells of thing{k} and place{k}</div>{more}"))
    made += [(count, "http://large/again", made[2][2]), (count + 1, "http://large/a", f"<article>{SAME}</article>"), (count + 2, "http://other/", SAME)]
    return spark.createDataFrame(made, "page_id long, url string, html string").repartition(parts)


def texts(table):
    return {r["page_id"]: r["text"] for r in pages.extract_pages(table).collect()}


def test_split_does_not_change_the_text(spark, monkeypatch):
    whole = texts(host(spark))
    assert SAME not in whole[1] and "only two pages" in whole[2] and whole[61] == whole[62] == SAME
    monkeypatch.setattr(pages, "SHARD_PAGES", 4)
    assert texts(host(spark)) == whole


@pytest.mark.parametrize("parts", [1, 7])
def test_size_in_characters_does_not_change_the_text(spark, monkeypatch, parts):
    whole = texts(host(spark))
    monkeypatch.setattr(pages, "SHARD_CHARS", 300)
    assert texts(host(spark, parts=parts)) == whole


def test_few_pages_of_many_characters(spark):
    own = " ".join(f"wx{i}" for i in range(800_000))
    made = [(k, f"http://big/{k}", f"<div>{SAME}</div><p>{own.replace('x', f'{k}x')}</p>") for k in range(3)]
    got = texts(spark.createDataFrame(made, "page_id long, url string, html string"))
    assert len(got) == 3 and all("fine stories" not in t for t in got.values())
