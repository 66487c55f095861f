"""Refresh the query column of COVERAGE.md from the registry."""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def main() -> None:
    from volpanel.plans import catalog

    queries: dict[str, list[str]] = {}
    for name, covers in catalog.COVERS.items():
        for item in covers.split():
            queries.setdefault(item, []).append(name if name in catalog.ORACLES else f"{name}*")
    path, lines = ROOT / "COVERAGE.md", []
    for line in (ROOT / "COVERAGE.md").read_text().splitlines():
        cells = [c.strip() for c in line.strip("|").split("|")]
        if len(cells) == 4 and cells[0] not in ("ID", "---"):
            cells[2] = ", ".join(queries.get(cells[0], [])) or "– (needs arriving files; unit tests only)"
            line = "| " + " | ".join(cells) + " |"
        lines.append(line)
    path.write_text("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
