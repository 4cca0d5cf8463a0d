"""Gradient queries against finite differences of the maps they name."""

import numpy as np
import pytest

from pathloom import options, queries
from pathloom.functions import branched, tensor

SF = "/root/testdata/sf0.001"
CASES = {
    "sig_combine_backprop": (queries.half_features(lambda c: queries.features.sig(c, 2)), "ab", lambda a, b: tensor.combine(a, b, 2, 2)),
    "sig_join_backprop": (queries.last_features(lambda c: queries.features.sig(c, 2)), ("h", "delta"), lambda h, x: tensor.join(h, x, 2, 2, False)),
    "sig_to_log_sig_backprop": (queries.path_feature(lambda c: queries.features.sig(c, 2)), "g", lambda g: tensor.sig_to_log_sig(g, 2, 2, 2)),
    "logsig_to_sig_backprop": (queries.path_feature(lambda c: queries.features.log_sig(c, 2, 2)), "g", lambda g: tensor.log_sig_to_sig(g, 2, 2, 2)),
    "log_sig_combine_backprop": (queries.half_features(lambda c: queries.features.log_sig(c, 2, 2)), "ab", lambda a, b: tensor.log_combine(a, b, 2, 2, 2)),
    "log_sig_join_backprop": (queries.last_features(lambda c: queries.features.log_sig(c, 2, 2)), ("h", "delta"), lambda h, x: tensor.log_join(h, x, 2, 2, 2)),
    "branched_sig_combine_backprop": (queries.half_features(lambda c: queries.features.branched_sig(c, 2)), "ab", lambda a, b: branched.combine(a, b, 2, 2)),
    "sig_join_prepend_backprop": (queries.last_features(lambda c: queries.features.sig(c, 2)), ("h", "delta"), lambda h, x: tensor.join(h, x, 2, 2, True)),
    "branched_sig_join_backprop": (queries.last_features(lambda c: queries.features.branched_sig(c, 2)), ("h", "delta"), lambda h, x: branched.join(h, x, 2, 2)),
    "branched_log_sig_join_backprop": (queries.last_features(lambda c: queries.features.branched_log_sig(c, 2, True, 2)), ("h", "delta"), lambda h, x: branched.log_join(h, x, 2, 2)),
    "linear_log_sig_backprop": (queries.last_step, ("delta",), lambda x: tensor.linear_log_sig(x, 2)),
    "linear_branched_sig_backprop": (queries.last_step, ("delta",), lambda x: branched.linear(x, 2)),
    "linear_branched_log_sig_backprop": (queries.last_step, ("delta",), lambda x: branched.linear_log(x, 2)),
    "branched_sig_to_log_sig_backprop": (queries.path_feature(lambda c: queries.features.branched_sig(c, 2)), "g", lambda g: branched.to_log(g, 2, 2, False, None)),
}


@pytest.mark.parametrize("name", CASES)
def test_gradient(spark, name):
    inputs, columns, fn = CASES[name]
    got = {r.key: r.gradient for r in (queries.QUERIES | options.QUERIES)[name](spark, SF).collect()}
    rows = inputs(spark, SF).collect()
    assert len(got) == len(rows) > 0
    for r in rows[:3]:
        xs = [np.array([r[c]], dtype=float) for c in columns]
        for k, x in enumerate(xs):
            for i in range(x.shape[1]):
                step = np.zeros(x.shape)
                step[0, i] = 1e-5
                up, down = ([y + s * step if j == k else y for j, y in enumerate(xs)] for s in (1, -1))
                want = (fn(*up).sum() - fn(*down).sum()) / 2e-5
                assert got[r.key][k][i] == pytest.approx(want, abs=1e-4, rel=1e-6)
