import numpy as np

from riskloom.operators import ml as M
from riskloom.operators import process as P
from riskloom.plans.model_queries import DEFECTIVE, ml_train_sgd

FOLDER = "/root/testdata/sf0.001"


def test_the_query_trains_all_500_epochs(spark):
    columns = [c for c in M.FEATURES if c != "bug_fix_commits"]
    rows = P.jit_features(P.changes_of(spark, FOLDER)).toPandas()
    for model in ml_train_sgd(spark, FOLDER).collect():
        own = rows[rows.analysis_id == model.analysis_id].sort_values("file_path")
        x = own[columns].to_numpy(float)
        w, b = M.sgd((x - np.array(model.means)) / np.array(model.stds), (own.bug_fix_commits >= DEFECTIVE).to_numpy(float), epochs=500)
        assert np.allclose(w, model.weights, rtol=1e-6, atol=1e-9) and np.isclose(b, model.bias, rtol=1e-6)
