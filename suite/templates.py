"""Texts of the source files of ``v_code``.

Slots: @W@ and @w@ a word of the document, @n@ its number, @t@ its text as comment lines.
"""

from __future__ import annotations

_JAVA = """import lib.src.@W@;
import static lib.util.*;

public class @W@ extends Base {
@t@
    // count @n@
    public int @w@One(int a) {
        if (a > @n@) {
            return a;
        }
        return 0;
    }

    private static void @w@Two(String s) throws Failure {
        call(s);
    }

    public int @w@One(long b) {
        return @w@One(0);
    }
}

"""

_PYTHON = """import os, sys
from lib.@w@ import @W@

class @W@:
@t@
    def @w@_one(self, a):
        if a > @n@:
\t\treturn a

        # none
        return 0

def @w@_two(s):
    return @W@(s)

# tail

def @w@_one(b):
    return b
"""

_SCRIPT = """import { @W@ } from './@w@';
const util = require('util/@n@');

export class @W@ {
@t@
  run(a) {
    if (a > @n@) {
      return a;
    }
  }
}
const @w@One = (x) => { return x; };
function @w@Two(s) {
  return @w@One(s);
}

// done
"""

_TYPED = """import { @W@ } from '../@w@';

export interface @W@Shape {
  size: number;
}
@t@
export class @W@ {
  run(a: number): number {
    for (let i = 0; i < @n@; i++) {
      a += i;
    }
    return a;
  }
}
const @w@One = x => x;
function @w@Two(s: string) {
  return @w@One(s);
}
"""

_CSHARP = """using System;
using Lib.@W@;

public class @W@ {
@t@
    public static int One(int a) => a + @n@;

    internal override void Two(string s) {
        if (s != null) {
            Call(s);
        }
    }
}
public struct @W@Pair {
    int x;
}
"""

_KOTLIN = """import lib.@w@.@W@
import lib.other;

class @W@(val n: Int) {
@t@
    fun one(a: Int): Int {
        return a + @n@
    }
    fun <T> List<T>.@w@Two(s: T) = s
}
object @W@Factory {
}
"""

_GO = """package @w@

import (
\t"fmt"
\tlib "example.org/@w@"
)

import "math"

type @W@ struct {
\tname string // of @n@
}

type @W@er interface {
\tRun() error
}

@t@

func New@W@(a int) *@W@ {
\tif a > @n@ {
\t\tfmt.Println("{ not a brace", '{')
\t}
\treturn &@W@{name: lib.Name(a)}
}

func (x *@W@) Run() error {
\treturn x.check(math.Sqrt(2))
}
"""

_TEXT = "@W@ @n@\n@t@\n"

# (extensions, comment mark, text)
TEMPLATES = [
    (["go"], "// ", _GO),
    (["java"], "    // ", _JAVA),
    (["py"], "    # ", _PYTHON),
    (["js", "jsx"], "  // ", _SCRIPT),
    (["ts", "tsx"], "// ", _TYPED),
    (["cs"], "    // ", _CSHARP),
    (["kt", "KTS"], "    // ", _KOTLIN),
    (["md", "txt"], "", _TEXT),
]
