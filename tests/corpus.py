"""A hand-written corpus: each file is there for one behaviour."""

SECRET = "A1b2C3d4E5f6G7h8"

FILES = {
    # one-line __all__; public name left out; private unused
    "/a/utils.py": '__all__ = ["kept"]\n\ndef kept():\n    pass\n\ndef left_out():\n    pass\n\ndef _hidden():\n    pass\n',
    # several lines: not understood, so all public names count as exported
    "/a/multi.py": '__all__ = [\n    "one",\n]\n\ndef one():\n    pass\n\ndef two():\n    pass\n',
    "/a/app.py": (
        "import os\nimport utils as u\nfrom helpers import *\nfrom pkg.core import build as make\n"
        "import numpy\nfrom nowhere import thing\n\nmake()\nu.kept()\nprint(os.sep, numpy, thing)\n"
    ),
    "/a/helpers.py": "def _star_private():\n    pass\n\ndef helper():\n    pass\n",
    "/a/pkg/__init__.py": "from .core import build, _exported\n",
    "/a/pkg/core.py": "def build():\n    pass\n\ndef _exported():\n    pass\n",
    "/a/pkg2/other.py": "def _exported():\n    pass\n",
    # "on" is inside other words, so it does not count as unused
    "/a/substring.py": "import on\n\ncondition = 1\n",
    "/a/dead.py": (
        "def _tangled(a):\n" + "".join(f"    if a > {i}:\n        a += 1\n" for i in range(6)) + "    return a\n"
    ),
    "/a/model.py": (
        'class Model:\n    """A documented class."""\n\n    def __init__(self):\n        self.x = 1\n\n'
        "    def busy(self, a):\n" + "".join(f"        if a > {i}:\n            a += 1\n" for i in range(6))
        + "        return a\n\n\nclass Tiny:\n    \"\"\"Tiny.\"\"\"\n\n\nModel().busy(1)\n"
    ),
    "/a/settings.py": (
        f'API_KEY = "{SECRET}"\nVERSION = "1.2.3.4.5.6.7"\nENV = "production"\n'
        'LONG = "Ab1Ab1Ab1Ab1Ab1"\nTOKEN = os.getenv("TOKEN")\n'
    ),
    # the match starts on line 3 and ends on line 4
    "/a/split.py": f'x = 1\n\nd = dict(password=\n  "{SECRET}")\n',
    "/a/calls.py": "def f(x):\n    return retrieval(x) + eval(x)\n",
    "/a/big451.py": "x = 1\n" * 451,
    "/a/big450.py": "x = 1\n" * 450,
    "/a/broken.py": "def (:\n",
    "/a/distance.py": "import os\n",
    "/a/build/gen.py": "import os\n",
    "/b/solo.py": "import json\n\ndef run():\n    return run2()\n\ndef run2():\n    pass\n",
}


def frame(spark, files=None):
    rows = [("/" + p.split("/")[1], p, c) for p, c in (files or FILES).items()]
    return spark.createDataFrame(rows, "repo string, path string, content string").coalesce(2)
