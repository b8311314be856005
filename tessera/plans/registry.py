"""Named components: (kind, name) -> class or function."""

from __future__ import annotations

from ..operators import cluster, codes, modes, select

_known: dict[tuple[str, str], object] = {}


def register(kind: str, name: str):
    """Decorator; a second component of one name is an error."""

    def keep(component):
        if (kind, name) in _known:
            raise ValueError(f"{kind} {name!r} is registered already")
        _known[kind, name] = component
        return component

    return keep


def available(kind: str) -> list[str]:
    return sorted(n for k, n in _known if k == kind)


def get(kind: str, name: str):
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} {name!r}; known: {', '.join(available(kind))}")
    return _known[kind, name]


def make(kind: str, name: str, **params):
    try:
        return get(kind, name)(**params)
    except KeyError as error:
        raise ValueError(str(error)) from None


@register("clusterer", "mi-leiden")
class MutualInformationCommunities:
    def __init__(self, resolution: float = 1.0, knn: int = 0, min_cluster_size: int = 1):
        self.options = {"resolution": resolution, "knn": knn, "min_size": min_cluster_size}

    def __call__(self, z, n_rows, key="battle_id"):
        return cluster.cluster_features(z, n_rows, "mi-leiden", key=key, **self.options)


@register("clusterer", "spherical-kmeans")
class SphericalKmeans:
    def __init__(self, n_clusters: int = 10, seed: int = 0):
        self.n_clusters, self.seed = n_clusters, seed

    def __call__(self, z, n_rows, key="battle_id"):
        return cluster.cluster_features(z, n_rows, "spherical-kmeans", self.n_clusters, key, seed=self.seed)


@register("clusterer", "agglomerative")
class Agglomerative:
    def __init__(self, n_clusters: int = 10):
        self.n_clusters = n_clusters

    def __call__(self, z, n_rows, key="battle_id"):
        return cluster.cluster_features(z, n_rows, "agglomerative", self.n_clusters, key)


for _kind in ("difference", "individual", "concat", "prompt"):
    register("representation", _kind)(lambda kind=_kind: lambda df: codes.represent(df, kind))

register("negatives", "random")(lambda: select.silent)
register("negatives", "close")(lambda: select.close_negatives)


for _mode in modes.MODES:
    register("interpreter", _mode)(lambda mode=_mode, **settings: modes.Interpreter(mode, **settings))


def interpreter_mode(mode: str, input_rep: str) -> str:
    """``auto`` follows the lens: prompts one text, individual codes one response, else pairs."""
    if mode != "auto":
        return mode
    return {"prompt": "single-text", "individual": "individual"}.get(input_rep, "pairwise")
