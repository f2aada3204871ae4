"""Every literal case gives its rows."""

import pytest

from compare import form
from literal_cases import CASES, Tables


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    f, (rows, names) = CASES[name]
    got = f(Tables(spark))
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(form(r[n]) for n in names) for r in got.collect()) == sorted(tuple(map(form, r)) for r in rows)
