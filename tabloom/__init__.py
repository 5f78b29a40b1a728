"""tabloom: report retrieval and table reasoning as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; none of them
triggers an action except the bounded size probes in ``tabloom.plans.sizing``.
"""

from tabloom.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
