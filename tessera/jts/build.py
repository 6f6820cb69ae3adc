"""python -m tessera.jts.build: compiles the Java sources against Spark's own jars into kernels.jar."""

from __future__ import annotations

import os
import subprocess
import tempfile
import zipfile

import pyspark

from . import spec

HERE = os.path.dirname(os.path.abspath(__file__))
JAR = os.path.join(HERE, "kernels.jar")


def build(jar: str = JAR) -> str:
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    with tempfile.TemporaryDirectory() as tmp:
        made = os.path.join(tmp, "Udfs.java")
        with open(made, "w") as f:
            f.write(spec.java_source())
        sources = [made] + [os.path.join(HERE, "java", "tessera", x) for x in ("Geo.java", "Geodesic.java", "Crs.java", "Aggregates.java", "Files.java")]
        subprocess.run(["javac", "-nowarn", "--release", "17", "-cp", jars, "-d", f"{tmp}/out", *sources], check=True)
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in sorted(os.walk(f"{tmp}/out")):
                for name in sorted(names):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, f"{tmp}/out"))
    return jar


if __name__ == "__main__":
    print(build())
