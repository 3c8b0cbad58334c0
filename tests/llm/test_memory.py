"""What the driver and the workers hold no longer than they need."""

import sys
import types
import weakref

import numpy as np

from seqloom.llm.suffixtree import sent_out
from seqloom.session import STATE, released


def test_tasks_of_another_kind_let_go_what_a_worker_kept():
    for keeps in (True, False):
        sys.modules[STATE] = types.ModuleType(STATE)
        assert list(released(iter, keeps)([1, 2])) == [1, 2]
        assert (STATE in sys.modules) == keeps
    assert STATE not in sys.modules


def test_the_driver_keeps_no_copy_of_what_it_broadcasts(spark):
    seen = []

    def made():
        x = np.arange(1000)
        seen.append(weakref.ref(x))
        return x

    held = sent_out(spark, made())
    assert seen[0]() is None and held.value.sum() == 499_500
