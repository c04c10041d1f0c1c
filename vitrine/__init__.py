"""vitrine: product-catalogue, search and event analytics as Spark jobs.

Every operator takes and returns DataFrames; nothing is collected to the
driver. Time-dependent operators take an explicit ``as_of`` clock.
"""

from vitrine.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
