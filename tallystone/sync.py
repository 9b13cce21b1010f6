"""Copies of finished reports on another host, over SSH.

A folder is packed into a staging directory beside its destination, which is then
put in place by two renames, so readers see the old files or the new ones. Both
ends are asked once for a compressor that they share; none is needed. What a
failed copy has left at the other end is removed.
"""

from __future__ import annotations

import os
import shlex
import shutil
import subprocess
from collections.abc import Callable

OPTIONS = ["-o", "ControlMaster=auto", "-o", "ControlPersist=60", "-o", "ConnectTimeout=10"]
#: Compressors by preference, as commands that read and write a pipe.
CODECS = {"zstd": ("zstd -q -T0 -c", "zstd -q -d -c"), "pigz": ("pigz -c", "pigz -d -c"), "gzip": ("gzip -c", "gzip -d -c")}


class Target:
    def __init__(self, host: str, folder: str, user: str = "", run: Callable[..., int] | None = None, password: str = ""):
        self.address, self.folder, self.password = f"{user}@{host}" if user else host, folder.rstrip("/"), password
        self.run = run or self.called

    def called(self, args: list[str], **more) -> int:
        """The command's exit status. A password goes through the environment, never the command line."""
        return subprocess.run(args, check=False, env=os.environ | ({"SSHPASS": self.password} if self.password else {}), **more).returncode

    def ssh(self, script: str) -> list[str]:
        asked = ["sshpass", "-e"] if self.password and shutil.which("sshpass") else []
        return [*asked, "ssh", *OPTIONS, *(() if asked else ("-o", "BatchMode=yes")), self.address, script]

    def codec(self) -> tuple[str, str] | None:
        """The first compressor that both ends have."""
        for name, pair in CODECS.items():
            if shutil.which(name) and not self.run(self.ssh(f"command -v {name} >/dev/null")):
                return pair
        return None

    def packed(self, folder: str, stage: str, codec: tuple[str, str] | None) -> bool:
        into = f"| {codec[1]} " if codec else ""
        pack = shlex.join(["tar", "-C", folder, "-cf", "-", "."]) + (f" | {codec[0]}" if codec else "")
        unpack = shlex.join(self.ssh(f"rm -rf {stage} && mkdir -p {stage} && cat {into}| tar -C {stage} -xf -"))
        return not self.run(["bash", "-c", f"set -o pipefail; {pack} | {unpack}"])

    def push_folder(self, folder: str, compress: bool = False) -> bool:
        """The folder's files replace what stands at the destination. Without success with a compressor it is tried once without."""
        final = shlex.quote(self.folder)
        stage, old = shlex.quote(self.folder + ".staging"), shlex.quote(self.folder + ".old")
        codec = self.codec() if compress else None
        if not (self.packed(folder, stage, codec) or codec and self.packed(folder, stage, None)):
            self.run(self.ssh(f"rm -rf {stage}"))
            return False
        return not self.run(self.ssh(f"rm -rf {old}; if [ -e {final} ]; then mv {final} {old}; fi; mv {stage} {final} && rm -rf {old}"))

    def push_file(self, path: str) -> bool:
        """One file, complete or not at all."""
        name = os.path.join(self.folder, os.path.basename(path))
        part = shlex.quote(name + ".part")
        script = f"mkdir -p {shlex.quote(self.folder)} && cat > {part} && mv {part} {shlex.quote(name)}"
        with open(path, "rb") as f:
            if not self.run(self.ssh(script), stdin=f):
                return True
        self.run(self.ssh(f"rm -f {part}"))
        return False
