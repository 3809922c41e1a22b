"""Learned models of one training set are fitted side by side, and every score is computed once."""
import threading

from basketry.operators import validation
from basketry.plans import register_customers as customers


class _Workspace:
    """The part of a workspace that fitting uses."""

    def __init__(self):
        self.models = {}

    def written(self, name, build):
        return None

    def fitted(self, name, fit):
        if name not in self.models:
            self.models[name] = fit()
        return self.models[name]


def test_boosted_models_are_fitted_together(monkeypatch):
    together = threading.Barrier(len(customers.BOOSTED), timeout=20)  # broken if one fit waits for another

    def fit(labelled, **setting):
        together.wait()
        return tuple(setting.items())

    monkeypatch.setattr(validation, "with_missing_flag", lambda df: df)
    monkeypatch.setattr(validation, "fit_trees", fit)
    ws = _Workspace()
    customers._fit_together(ws, list(customers.BOOSTED))
    assert ws.models == {name: tuple(setting.items()) for name, setting in customers.BOOSTED.items()}


def test_scores_of_all_methods_are_written_before_they_are_compared(monkeypatch):
    class Written(_Workspace):
        names = []

        def written(self, name, build):
            self.names.append(name)
            return build()

    class Scores:
        def select(self, *columns):
            return self

        def unionByName(self, other):
            return self

    for name in ("_methods", "_rounded_method", "_logistic_scores", "_boosted_scores"):
        monkeypatch.setattr(customers, name, lambda ws: Scores())
    monkeypatch.setattr(customers, "_fit_together", lambda ws, methods: None)
    monkeypatch.setattr(validation, "compare_methods", lambda scores: scores)
    ws = Written()
    customers.all_methods(ws)
    assert ws.names == ["tier_methods", "method_scores"]
