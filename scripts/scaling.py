"""Core scaling of selected jobs: one fresh local session per core count,
each running ``bench.py`` restricted to the given queries.

    python scripts/scaling.py [--sf /root/testdata/sf0.1] [--cores 1,2,4,8] [q ...]
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--cores", default="1,2,4,8")
    ap.add_argument("names", nargs="*", default=["p_candidates", "p_scores", "bfs_depth2"])
    args = ap.parse_args()
    out = {}
    for c in args.cores.split(","):
        env = dict(os.environ, BENCH_SF_DIR=args.sf, BENCH_CPUS=c,
                   BENCH_QUERIES=",".join(args.names), BENCH_SHUFFLE=str(max(2 * int(c), 4)))
        res = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                             capture_output=True, text=True, timeout=1800)
        line = [ln for ln in res.stdout.splitlines() if ln.startswith("{")]
        out[c] = json.loads(line[-1])["queries"] if line else {"error": res.stderr[-500:]}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
