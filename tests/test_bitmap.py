import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions.bitmap import DENSE, Bitmap

ids = st.one_of(st.sets(st.integers(0, 300_000), max_size=200), st.builds(lambda a, n, k: set(range(a, a + n * k, k)), st.integers(0, 70_000), st.integers(0, 9000), st.integers(1, 3)))


@settings(max_examples=60, deadline=None)
@given(ids, ids)
def test_set_operations(a, b):
    x, y = Bitmap.of(list(a)), Bitmap.of(list(b))
    assert set(x.decode()) == a and len(x) == len(a)
    assert set(x.and_not(y).decode()) == a - b
    assert set(x.and_(y).decode()) == a & b


def test_forms():
    thin, dense = Bitmap.of([1, 5, 70_000]), Bitmap.of(np.arange(DENSE + 1))
    assert thin.nbytes() == 6 and dense.nbytes() == 8192
    assert len(dense.and_not(Bitmap.of(np.arange(DENSE)))) == 1
    assert len(Bitmap.of([])) == 0 and list(Bitmap().decode()) == []
