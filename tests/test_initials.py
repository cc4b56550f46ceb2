"""An author's initial is one letter, as SQL's upper() gives it, also where Unicode's capital is several letters (ß, SS)."""

import pytest
from oracle import both

from corvina.plans.catalogue import ORACLE, QUERIES

#: Letters with capitals of several letters or of none, and two with usual ones.
LETTERS = "ßŉǰΐևẖᾀᾈᾳᾼῆῳﬁﬗɤéj"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("initials")
    rows = [(i, f"title words {' '.join(f'w{i}x{k}' for k in range(11))} name {c}tail and more", "de", "web", 0) for i, c in enumerate(LETTERS * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["export_bibtex", "export_ris", "export_screening", "map_crossref", "read_wos", "read_nbib", "read_ris"])
def test_initial(spark, folder, name):
    ours, theirs = both(spark, QUERIES[name], ORACLE[name], folder)
    assert ours[1] and ours == theirs
