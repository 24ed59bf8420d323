"""Bytes that batches and buffers may hold: in all, and per tenant."""

from __future__ import annotations

import threading
from collections import defaultdict


class ByteBudget:
    """A reservation is made whole or not at all. Safe for several threads."""

    def __init__(self, capacity: int, per_tenant: int = 0):
        """per_tenant: 0 for as much as capacity."""
        if capacity <= 0 or per_tenant < 0:
            raise ValueError("a budget must be above zero")
        self.capacity, self.per_tenant = capacity, min(per_tenant or capacity, capacity)
        self.in_use, self._of = 0, defaultdict(int)
        self._lock = threading.Lock()

    def reserve(self, n: int, tenant_id: str = "") -> bool:
        with self._lock:
            if self._of[tenant_id] + n > self.per_tenant or self.in_use + n > self.capacity:
                self._drop_empty(tenant_id)
                return False
            self._of[tenant_id] += n
            self.in_use += n
            return True

    def release(self, n: int, tenant_id: str = "") -> None:
        with self._lock:
            if n > self._of[tenant_id]:
                self._drop_empty(tenant_id)
                raise ValueError("more is released than was reserved")
            self._of[tenant_id] -= n
            self.in_use -= n
            self._drop_empty(tenant_id)

    def _drop_empty(self, tenant_id: str) -> None:
        # Tenants that hold nothing take no memory.
        if not self._of[tenant_id]:
            del self._of[tenant_id]

    def of_tenant(self, tenant_id: str) -> int:
        with self._lock:
            return self._of.get(tenant_id, 0)
