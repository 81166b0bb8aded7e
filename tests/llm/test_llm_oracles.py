import oracle
import pytest

from sparkloom.llm import queries as Q


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name, folder):
    con = oracle.connect(folder)
    assert oracle.differences(spark, con, folder, Q.queries()[name], Q.oracle_sql()[name]) is None


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))
