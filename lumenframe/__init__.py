"""Lumenframe: a lazy columnar analytics engine on Spark's DataFrame API."""

__all__ = ["Frame", "Series", "merge"]


def __getattr__(name: str):
    # on demand, so that Python workers that need one function don't load everything
    if name in ("Frame", "Series"):
        from .operators import frame

        return getattr(frame, name)
    if name == "merge":
        from .operators.relational import merge

        return merge
    raise AttributeError(name)
