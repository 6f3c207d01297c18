"""Document evidence on Spark: chunk, retrieve, verify and cite, as DataFrame operators."""

from proofloom.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
