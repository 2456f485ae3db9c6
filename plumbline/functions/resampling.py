"""Poisson(1) weights of resampled families, many draws of one family at a time.

A draw is four bytes of SHA-256, so 2,000 draws are 250 digests of a family. Spark has no function for many digests of one
value and one object per digest takes most of the time in Python, so the loop over them is a small class for Spark's own JVM:
compiled by the compiler Spark generates its code with, and sent to the executors as a jar.
"""

from __future__ import annotations

import hashlib
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .hashing import _c
from .stats import POISSON_STEPS

CLASS = "plumbline.PoissonWeights"
SOURCE = """
package plumbline;

import java.security.MessageDigest;

public final class PoissonWeights implements org.apache.spark.sql.api.java.UDF1 {
    private final byte[] seed;
    private final int draws;
    private final long[] steps;
    private transient MessageDigest sha;
    private transient byte[] digest;
    private transient byte[][] heads;
    private transient byte[] byHighBits;  // the weight of the 2^20 values that share their high bits, -1 where they differ

    public PoissonWeights(byte[] seed, Integer draws, String steps) {
        this.seed = seed;
        this.draws = draws.intValue();
        String[] parts = steps.split(",");
        this.steps = new long[parts.length];
        for (int i = 0; i < parts.length; i++) this.steps[i] = Long.parseLong(parts[i]);
    }

    private int weight(long value) {
        int w = 0;
        while (steps[w] < value) w++;
        return w;
    }

    private void prepare() throws Exception {
        heads = new byte[(draws + 7) / 8][];
        for (int i = 0; i < heads.length; i++) {
            byte[] tail = (":" + i + ":").getBytes("UTF-8");
            heads[i] = java.util.Arrays.copyOf(seed, seed.length + tail.length);
            System.arraycopy(tail, 0, heads[i], seed.length, tail.length);
        }
        byHighBits = new byte[4096];
        for (int i = 0; i < 4096; i++) {
            long low = ((long) i) << 20;
            int w = weight(low);
            byHighBits[i] = (byte) (w == weight(low + 0xFFFFFL) ? w : -1);
        }
        digest = new byte[32];
        sha = MessageDigest.getInstance("SHA-256");
    }

    public Object call(Object family) throws Exception {
        if (sha == null) prepare();
        byte[] name = (byte[]) family;
        byte[] out = new byte[draws];
        for (int i = 0, at = 0; i < heads.length; i++) {
            sha.update(heads[i]);
            sha.update(name);
            sha.digest(digest, 0, 32);
            for (int j = 0; j < 32 && at < draws; j += 4) {
                int high = (digest[j] & 255) << 8 | (digest[j + 1] & 255);
                byte w = byHighBits[high >> 4];
                out[at++] = w >= 0 ? w : (byte) weight(((long) high) << 16 | (digest[j + 2] & 255) << 8 | (digest[j + 3] & 255));
            }
        }
        return out;
    }
}
"""

_LOADERS: dict[str, object] = {}


def _loader(spark: SparkSession):
    """The loader of the compiled class on the driver; the executors get it as a jar, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _LOADERS:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        jar = f"{tempfile.mkdtemp(prefix='plumbline-')}/plumbline-weights.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(jar)
        _LOADERS[sc.applicationId] = compiler.getClassLoader()
    return _LOADERS[sc.applicationId]


def weights_of(family, draws: int, seed: str) -> bytes:
    """The same weights in Python, digest by digest: for a family whose text Spark writes otherwise."""
    hashed = b"".join([hashlib.sha256(f"{seed}:{i}:{family}".encode()).digest() for i in range(-(-draws // 8))])
    values = np.frombuffer(hashed, ">u4")[:draws].astype(np.uint32)
    return np.searchsorted(np.array(POISSON_STEPS, dtype=np.uint32), values).astype(np.uint8).tobytes()


def poisson_weights(spark: SparkSession, family, draws: int, seed: str) -> Column:
    """The weights of a family (text or a whole number) in all draws, a byte each: draw b is four bytes of sha256 of the seed,
    b // 8 and the family."""
    sc = spark.sparkContext
    given = sc._gateway.new_array(sc._jvm.java.lang.Object, 3)
    given[0], given[1], given[2] = seed.encode(), draws, ",".join(map(str, POISSON_STEPS))
    made = _loader(spark).loadClass(CLASS).getConstructors()[0].newInstance(given)
    name = f"plumbline_poisson_{draws}_{seed.encode().hex()}"
    spark._jsparkSession.udf().register(name, made, sc._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_function(name, _c(family).cast("string").cast("binary"))
