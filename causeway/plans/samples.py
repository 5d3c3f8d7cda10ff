"""Small source trees for the extraction queries, and what each must give, worked out by hand."""

PYTHON = {
    "shop/__init__.py": "",
    "shop/flour.py": "rye = wheat = 1\n",
    "shop/oven.py": "import importlib\nfrom .flour import (\n    rye as dark,\n    wheat,\n)\n\ndef bake(kind):\n    importlib.import_module(kind)\n    return importlib.import_module(\"shop.recipes\")\n",
    "shop/recipes/__init__.py": "from .. import oven\nfrom . import loaf as l, missing\n",
    "shop/recipes/loaf.py": "from typing import TYPE_CHECKING as T\nimport typing\nif typing.TYPE_CHECKING:\n    from shop.oven import bake\nelse:\n    import shop.flour as f, os\n",
    "till.py": "import shop.oven, shop\ntext = '''\nimport shop.flour\n'''\nfrom shop.recipes import *  # all of them\n",
}
#: (path, is_from, module, names, level, kind, line, skipped)
PYTHON_IMPORTS = [
    ("shop/oven.py", False, "importlib", "", 0, "value", 1, 0), ("shop/oven.py", True, "flour", "rye|wheat", 1, "value", 2, 0), ("shop/oven.py", False, "", "", 0, "dynamic", 8, 1), ("shop/oven.py", False, "shop.recipes", "", 0, "dynamic", 9, 0),
    ("shop/recipes/__init__.py", True, "", "oven", 2, "value", 1, 0), ("shop/recipes/__init__.py", True, "", "loaf|missing", 1, "value", 2, 0),
    ("shop/recipes/loaf.py", True, "typing", "TYPE_CHECKING", 0, "value", 1, 0), ("shop/recipes/loaf.py", False, "typing", "", 0, "value", 2, 0), ("shop/recipes/loaf.py", True, "shop.oven", "bake", 0, "type", 4, 0), ("shop/recipes/loaf.py", False, "shop.flour", "", 0, "value", 6, 0), ("shop/recipes/loaf.py", False, "os", "", 0, "value", 6, 0),
    ("till.py", False, "shop.oven", "", 0, "value", 1, 0), ("till.py", False, "shop", "", 0, "value", 1, 0), ("till.py", True, "shop.recipes", "*", 0, "value", 5, 0),
]
#: (src, dst, kind, weight, line)
PYTHON_EDGES = [
    ("shop/oven.py", "shop/flour.py", "value", 1, 2), ("shop/oven.py", "shop/recipes/__init__.py", "dynamic", 1, 9), ("shop/recipes/__init__.py", "shop/__init__.py", "value", 1, 1), ("shop/recipes/__init__.py", "shop/oven.py", "value", 1, 1), ("shop/recipes/__init__.py", "shop/recipes/loaf.py", "value", 1, 2),
    ("shop/recipes/loaf.py", "shop/oven.py", "type", 1, 4), ("shop/recipes/loaf.py", "shop/flour.py", "value", 1, 6), ("till.py", "shop/oven.py", "value", 1, 1), ("till.py", "shop/__init__.py", "value", 1, 1), ("till.py", "shop/recipes/__init__.py", "value", 1, 5),
]

TYPESCRIPT = {
    "src/kiln.ts": "import { Clay, type Glaze } from './stock';\nimport type { Pot } from \"./pots/jug.js\";\nimport fire = require(\"./fire\");\nexport * from '@parts/rim';\nconst quote = /['\"`]/g, half = 4 / 2 / 1;\nconst note = `see ${await import('./pots')} and import x from './none'`;\nexport async function open(name: string) { return import(`./${name}`); }\n",
    "src/pots/index.ts": "export { Jug } from './jug';\nexport type { Size } from './jug';\nimport '../stock';\n",
    "src/pots/jug.ts": "import { type Size } from '../stock';\nexport class Jug {}\n",
    "src/stock.ts": "export type Size = number;\n",
    "src/fire/index.ts": "import {} from '../stock';\nimport missing from './gone';\nimport fs from 'fs';\n",
    "lib/parts/rim.tsx": "export const Rim = () => <p>it's import y from '../none'</p>;\n",
}
TYPESCRIPT_ALIASES = [("@parts/", "lib/parts")]
#: (path, specifier, kind, line, skipped)
TYPESCRIPT_IMPORTS = [
    ("src/kiln.ts", "./stock", "value", 1, 0), ("src/kiln.ts", "./pots/jug.js", "type", 2, 0), ("src/kiln.ts", "./fire", "value", 3, 0), ("src/kiln.ts", "@parts/rim", "value", 4, 0), ("src/kiln.ts", "./pots", "dynamic", 6, 0), ("src/kiln.ts", "", "dynamic", 7, 1),
    ("src/pots/index.ts", "./jug", "value", 1, 0), ("src/pots/index.ts", "./jug", "type", 2, 0), ("src/pots/index.ts", "../stock", "value", 3, 0), ("src/pots/jug.ts", "../stock", "type", 1, 0),
    ("src/fire/index.ts", "../stock", "value", 1, 0), ("src/fire/index.ts", "./gone", "value", 2, 0), ("src/fire/index.ts", "fs", "value", 3, 0),
]
#: (src, dst, kind, weight, line)
TYPESCRIPT_EDGES = [
    ("src/kiln.ts", "src/stock.ts", "value", 1, 1), ("src/kiln.ts", "src/pots/jug.ts", "type", 1, 2), ("src/kiln.ts", "src/fire/index.ts", "value", 1, 3), ("src/kiln.ts", "lib/parts/rim.tsx", "value", 1, 4), ("src/kiln.ts", "src/pots/index.ts", "dynamic", 1, 6),
    ("src/pots/index.ts", "src/pots/jug.ts", "value", 1, 1), ("src/pots/index.ts", "src/pots/jug.ts", "type", 1, 2), ("src/pots/index.ts", "src/stock.ts", "value", 1, 3), ("src/pots/jug.ts", "src/stock.ts", "type", 1, 1), ("src/fire/index.ts", "src/stock.ts", "value", 1, 1),
]
