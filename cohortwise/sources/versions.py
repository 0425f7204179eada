"""Names of versions and batches."""

from __future__ import annotations

import time
import uuid


def version_name() -> str:
    """Sortable and collision-free."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
