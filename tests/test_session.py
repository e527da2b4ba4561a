import zipfile


def test_code_is_shipped_as_a_package(spark, monkeypatch):
    from siftline.session import ship_code

    sent = []
    monkeypatch.setattr("siftline.session._shipped", set())
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    ship_code(spark)
    ship_code(spark)
    assert len(sent) == 1
    names = zipfile.ZipFile(sent[0]).namelist()
    assert "siftline/__init__.py" in names and "siftline/operators/page_dom.py" in names
