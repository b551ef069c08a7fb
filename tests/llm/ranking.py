def auc(score, label):
    """Area under the ROC curve, ties counted half."""
    import pandas as pd

    r = pd.Series(list(score)).rank().to_numpy()
    y = pd.Series(list(label)).to_numpy() == 1
    n1, n0 = y.sum(), (~y).sum()
    return (r[y].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
