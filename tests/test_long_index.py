"""An index of more pages than any default bound."""

import pytest

from corpusledger.sources import contract, paged

PAGES = 1100


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("index")
    for i in range(PAGES):
        (folder / f"page-{i}.html").write_text(f"<aside class='doc loi'><a href='/doc/p{i}/' class='doc-title t'>t{i}</a> Publi\u00e9 le 01.07.2026</aside>")
    paged.register(spark)
    return contract.PagedSource("x.long", str(folder))


def test_every_page_is_discovered(spark, source):
    got = source.discover(spark)
    assert sorted(r.page for r in got.select("page").collect()) == list(range(PAGES))
    assert got.rdd.getNumPartitions() <= PAGES // paged.RUN + 1


def test_every_reference_is_described(source, spark):
    got = source.describe(source.discover(spark))
    assert sorted(r[0] for r in got.select("metadata.common.title").collect()) == sorted(f"t{i}" for i in range(PAGES))


def test_every_reference_is_resolved(source, spark):
    got = source.resolve(source.discover(spark))
    assert sorted(r.url for r in got.select("url").collect()) == sorted(f"http://localhost/doc/p{i}/" for i in range(PAGES))
