import numpy as np
import pytest

from motionframe.functions.kernels import disc, ellipse, gaussian_taps, gaussian_weights, runs, taps_of
from motionframe.params import DetectParams


@pytest.mark.parametrize(("k", "n"), [(1, 0), (3, 1), (5, 9), (7, 25), (9, 45), (15, 145)])
def test_disc_sizes(k, n):
    assert len(disc(k)) == n


def test_gaussian_sums_to_one():
    for k, s in ((5, 0.2), (15, 2.0), (15, 0.2)):
        assert abs(gaussian_weights(k, s).sum() - 1) < 0.01
        assert abs(sum(w for *_, w in gaussian_taps(k, s)) / 2**47 - 1) < 1e-6


def test_weights_are_whole_at_the_scale():
    w = gaussian_weights(15, 2.0).astype(np.float64) * 2.0**47
    assert (w == np.rint(w)).all()
    assert w.sum() * 255 < 2**55


def test_runs_cover_the_disc():
    assert runs(disc(15)) == {dy: {0: 6, 1: 6, 2: 6, 3: 6, 4: 5, 5: 4, 6: 3}[abs(dy)] for dy in range(-6, 7)}


def test_ellipse_is_symmetric():
    e = set(ellipse(15))
    assert all((-y, -x) in e for y, x in e) and (0, 7) in e and (7, 0) in e


def test_taps_of():
    assert taps_of(np.eye(3, dtype=int)) == ((-1, -1, 1), (0, 0, 1), (1, 1, 1))


def test_params_are_checked():
    for bad in ({"ksize": 4}, {"gray": "x"}, {"morphology": "x"}, {"border": "x"}):
        with pytest.raises(ValueError):
            DetectParams(**bad)
