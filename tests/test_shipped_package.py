"""The package as executors see it: a zip on the path, no folder beside it."""
import os
import subprocess
import sys
import tempfile
import zipfile

import sift


def test_modules_with_python_stages_load_from_a_zip():
    home = os.path.dirname(os.path.abspath(sift.__file__))
    d = tempfile.mkdtemp(prefix="sift-zip-")
    with zipfile.ZipFile(f"{d}/sift.zip", "w") as z:
        for root, _, files in os.walk(home):
            for f in files:
                if f.endswith((".py", ".txt")):
                    z.write(os.path.join(root, f), os.path.relpath(os.path.join(root, f), os.path.dirname(home)))
    names = sorted(f[:-3] for f in os.listdir(f"{home}/operators") if f.endswith(".py") and f != "__init__.py")
    code = f"import sys, importlib; sys.path.insert(0, './sift.zip'); [importlib.import_module('sift.operators.' + n) for n in {names}]; " \
           "from sift.operators import lexical; assert '.zip' in lexical.__file__; print(len(lexical.STOP_WORDS), lexical.STOP_WORDS[0])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=d, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    from sift.operators.lexical import STOP_WORDS
    assert got.stdout.split() == [str(len(STOP_WORDS)), STOP_WORDS[0]]


def test_keyword_modules_need_no_other_files_or_packages():
    """Modules alone, without the text files beside them and without hash packages, count terms as here."""
    home = os.path.dirname(os.path.abspath(sift.__file__))
    d = tempfile.mkdtemp(prefix="sift-zip-")
    with zipfile.ZipFile(f"{d}/sift.zip", "w") as z:
        for root, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(root, f), os.path.relpath(os.path.join(root, f), os.path.dirname(home)))
    code = "import sys; sys.path.insert(0, './sift.zip'); sys.modules['xxhash'] = None; " \
           "from sift.operators import block_max, hybrid, lexical, segments; assert '.zip' in lexical.__file__; " \
           "import numpy as np; print(len(lexical.STOP_WORDS), lexical._asked(['a b', 'c'], np.full(1 << 21, 255, np.uint8)).all())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=d, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split() == ["181", "True"]
