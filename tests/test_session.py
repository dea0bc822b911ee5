import os

import pytest

from matchloom import session


def files(spark):
    base = session.shared_dir(spark).removeprefix("file:")
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names}


def test_scopes_delete_what_operators_wrote(spark):
    df = spark.range(100)
    before = files(spark)
    with session.scratch():
        kept = session.reliable(df)
        with session.scratch():
            assert session.reliable(df).count() == session.stored(df).count() == 100
            assert len(files(spark)) > len(before)
        assert kept.count() == 100
    assert files(spark) == before
    with pytest.raises(ZeroDivisionError), session.scratch():
        session.stored(df)
        raise ZeroDivisionError
    assert files(spark) == before


def test_release(spark):
    before = files(spark)
    made = session.reliable(spark.range(10))
    assert len(files(spark)) > len(before)
    session.release(made)
    assert files(spark) == before
