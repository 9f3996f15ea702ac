"""Input paths from what a user types."""

from __future__ import annotations

import glob
import os
import warnings
from collections.abc import Sequence


def resolve_inputs(text: str, extensions: Sequence[str] | None = None) -> list[str]:
    """Files of a comma-separated list of files, folders (not their subfolders) and patterns with ``*``, ``?`` and ``**``.

    Quotes round an entry are dropped; files whose name ends with none of ``extensions`` (in any case) are left out; the
    order of first mention stays and repeats are dropped. A path that isn't there gives a warning.
    """
    wanted = tuple(e.lower() for e in extensions) if extensions is not None else None
    found: dict[str, None] = {}
    for entry in filter(None, (part.strip() for part in text.split(","))):
        entry = entry.strip("'\"")
        matches = glob.glob(entry, recursive=True) if any(c in entry for c in "*?") else [entry]
        present = [m for m in matches if os.path.exists(m)]
        if not present:
            warnings.warn(f"no such input: {entry}", stacklevel=2)
        for path in present:
            inside = [os.path.join(path, n) for n in sorted(os.listdir(path))] if os.path.isdir(path) else [path]
            for p in inside:
                if os.path.isfile(p) and (wanted is None or os.path.basename(p).lower().endswith(wanted)):
                    found.setdefault(os.path.normpath(p))
    return list(found)
