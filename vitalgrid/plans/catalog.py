"""All registered queries."""

from vitalgrid.plans import alerts, charts, live, medication, people, scores, sharing, text  # noqa: F401
from vitalgrid.plans import shapes, streamed  # noqa: F401, I001  (uses the statements of the others)
from vitalgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
