"""A model of every kind of type, and the texts that each export format makes of it, written down."""

from __future__ import annotations

from quillstone.plans import export as ex
from quillstone.plans import model as m


def context() -> ex.Context:
    hue = m.Enum("Hue", (("Red", 0), ("Blue", 4)))
    code = m.Enum("Code", (("low", -1), ("high", 2)), integer=True)
    leaf = m.record("Leaf", x=m.Int())
    a, b = m.Record("Same", (m.Field("k", m.Int(64)),), "a"), m.Record("Same", (m.Field("_t", m.Text()),), "b::c")
    tree = m.record(
        "Tree", leaf=m.Optional(leaf), om=m.Omittable(m.Double()), omo=m.Omittable(m.Optional(m.Bool())), tags=m.Vector(m.Text()), pair=m.Fixed(m.Int(), 2), by=m.Map(leaf), raw=m.Raw(), hue=hue, code=code, u=m.Internal("type", ((2, a), (3, b))), again=m.Optional(m.Ref("Tree"))
    )
    return ex.Context([tree], [ex.Command("files.list", m.Record("Nothing"), tree), ex.Command("files.drop", leaf, None), ex.Command("ping")], [ex.EventType("grown", tree)], "forest")


TEXTS: dict[str, str] = {}

TEXTS[".schema.json"] = r"""
{
  "$defs": {
    "Leaf": {
      "type": "object",
      "properties": {
        "x": {
          "type": "integer"
        }
      },
      "required": [
        "x"
      ]
    },
    "Hue": {
      "type": "string",
      "enum": [
        "Red",
        "Blue"
      ]
    },
    "Code": {
      "type": "integer",
      "enum": [
        -1,
        2
      ],
      "x-enumNames": [
        "low",
        "high"
      ]
    },
    "a_Same": {
      "type": "object",
      "properties": {
        "k": {
          "type": "integer",
          "format": "int64"
        }
      },
      "required": [
        "k"
      ]
    },
    "b_c_Same": {
      "type": "object",
      "properties": {
        "_t": {
          "type": "string"
        }
      },
      "required": [
        "_t"
      ]
    },
    "Tree": {
      "type": "object",
      "properties": {
        "leaf": {
          "allOf": [
            {
              "$ref": "#/$defs/Leaf"
            }
          ],
          "nullable": true
        },
        "om": {
          "type": "number"
        },
        "omo": {
          "type": "boolean",
          "nullable": true
        },
        "tags": {
          "type": "array",
          "items": {
            "type": "string"
          }
        },
        "pair": {
          "type": "array",
          "items": {
            "type": "integer"
          },
          "minItems": 2,
          "maxItems": 2
        },
        "by": {
          "type": "object",
          "additionalProperties": {
            "$ref": "#/$defs/Leaf"
          }
        },
        "raw": {},
        "hue": {
          "$ref": "#/$defs/Hue"
        },
        "code": {
          "$ref": "#/$defs/Code"
        },
        "u": {
          "oneOf": [
            {
              "allOf": [
                {
                  "$ref": "#/$defs/a_Same"
                },
                {
                  "type": "object",
                  "properties": {
                    "type": {
                      "const": 2
                    }
                  },
                  "required": [
                    "type"
                  ]
                }
              ]
            },
            {
              "allOf": [
                {
                  "$ref": "#/$defs/b_c_Same"
                },
                {
                  "type": "object",
                  "properties": {
                    "type": {
                      "const": 3
                    }
                  },
                  "required": [
                    "type"
                  ]
                }
              ]
            }
          ]
        },
        "again": {
          "allOf": [
            {
              "$ref": "#/$defs/Tree"
            }
          ],
          "nullable": true
        }
      },
      "required": [
        "tags",
        "pair",
        "by",
        "raw",
        "hue",
        "code",
        "u"
      ]
    }
  }
}
"""

TEXTS[".ts"] = r"""
export interface Leaf {
  x: number;
}

export type Hue = "Red" | "Blue";

export enum Code {
  low = -1,
  high = 2,
}

export interface a_Same {
  k: number;
}

export interface b_c_Same {
  _t: string;
}

export interface Tree {
  leaf: Leaf | null;
  om?: number;
  omo?: boolean | null;
  tags: string[];
  pair: [number, number];
  by: Record<string, Leaf>;
  raw: unknown;
  hue: Hue;
  code: Code;
  u: (a_Same & { type: 2 }) | (b_c_Same & { type: 3 });
  again: Tree | null;
}
"""

TEXTS[".zod.ts"] = r"""
import { z } from "zod";

export const LeafSchema = z.object({
  x: z.number().int(),
});
export type Leaf = z.infer<typeof LeafSchema>;

export const HueSchema = z.union([z.literal("Red"), z.literal("Blue")]);
export type Hue = z.infer<typeof HueSchema>;

export const CodeSchema = z.union([z.literal(-1), z.literal(2)]);
export type Code = z.infer<typeof CodeSchema>;

export const a_SameSchema = z.object({
  k: z.number().int(),
});
export type a_Same = z.infer<typeof a_SameSchema>;

export const b_c_SameSchema = z.object({
  _t: z.string(),
});
export type b_c_Same = z.infer<typeof b_c_SameSchema>;

export const TreeSchema: z.ZodType<any> = z.object({
  leaf: LeafSchema.nullable(),
  om: z.number().optional(),
  omo: z.boolean().nullish(),
  tags: z.array(z.string()),
  pair: z.array(z.number().int()).length(2),
  by: z.record(z.string(), LeafSchema),
  raw: z.unknown(),
  hue: HueSchema,
  code: CodeSchema,
  u: z.union([a_SameSchema.and(z.object({ type: z.literal(2) })), b_c_SameSchema.and(z.object({ type: z.literal(3) }))]),
  again: z.lazy(() => TreeSchema).nullable(),
});
export type Tree = z.infer<typeof TreeSchema>;
"""

TEXTS[".events.ts"] = r"""
import type { Code, Hue, Leaf, Tree, a_Same, b_c_Same } from "./forest";

export interface Events {
  "grown": Tree;
}

export type EventName = keyof Events;

export interface EventBus {
  on<N extends EventName>(name: N, listener: (payload: Events[N]) => void): () => void;
}
"""

TEXTS[".bridge.ts"] = r"""
export type Invoke = (name: string, payload: unknown) => Promise<unknown>;

export class Emitter {
  private readonly listeners = new Map<string, Set<(payload: unknown) => void>>();

  on(name: string, listener: (payload: unknown) => void): () => void {
    const held = this.listeners.get(name) ?? new Set();
    this.listeners.set(name, held.add(listener));
    return () => void held.delete(listener);
  }

  emit(name: string, payload: unknown): void {
    for (const listener of [...(this.listeners.get(name) ?? [])]) listener(payload);
  }
}

export interface Transport<E extends object = object> {
  invoke: Invoke;
  on?<N extends Extract<keyof E, string>>(name: N, listener: (payload: E[N]) => void): () => void;
}

/** A backend over a transport, with the transport's events where it has any. */
export function connect<B extends object, E extends object = object>(transport: Transport<E>, create: (invoke: Invoke) => B): B & Pick<Transport<E>, "on"> {
  const made = create((name, payload) => transport.invoke(name, payload));
  return Object.assign(made, { on: transport.on && transport.on.bind(transport) });
}
"""

TEXTS[".backend.ts"] = r"""
import type { Code, Hue, Leaf, Tree, a_Same, b_c_Same } from "./forest";
import type { Invoke } from "./forest.bridge";

export function createBackend(invoke: Invoke) {
  return {
    files: {
      list: () => invoke("files.list", {}) as Promise<Tree>,
      drop: (request: Leaf) => invoke("files.drop", request) as Promise<void>,
    },
    ping: () => invoke("ping", {}) as Promise<void>,
  };
}
"""

TEXTS[".server.ts"] = r"""
import type { Code, Hue, Leaf, Tree, a_Same, b_c_Same } from "./forest";

export interface Handlers {
    files: {
      list: () => Tree | Promise<Tree>;
      drop: (request: Leaf) => void | Promise<void>;
    };
    ping: () => void | Promise<void>;
}

export class CommandError extends Error {
  constructor(readonly status: number, message: string) {
    super(message);
  }
}

export async function dispatch(handlers: Handlers, name: string, payload: unknown): Promise<unknown> {
  switch (name) {
    case "files.list":
      return handlers["files"]["list"]();
    case "files.drop":
      return handlers["files"]["drop"](payload as never);
    case "ping":
      return handlers["ping"]();
    default:
      throw new CommandError(404, `unknown command ${name}`);
  }
}
"""

TEXTS[".h"] = r"""
#pragma once

#include <array>
#include <cstdint>
#include <map>
#include <optional>
#include <string>
#include <variant>
#include <vector>

struct Leaf
{
    std::int32_t x {};
};

enum class Hue
{
    Red = 0,
    Blue = 4,
};

enum class Code
{
    low = -1,
    high = 2,
};

struct a_Same
{
    std::int64_t k {};
};

struct b_c_Same
{
    std::string _t {};
};

struct Tree
{
    std::optional<Leaf> leaf {};
    std::optional<double> om {};
    std::optional<std::optional<bool>> omo {};
    std::vector<std::string> tags {};
    std::array<std::int32_t, 2> pair {};
    std::map<std::string, Leaf> by {};
    std::string raw {};
    Hue hue {};
    Code code {};
    std::variant<a_Same, b_c_Same> u {};
    std::optional<Tree> again {};
};
"""

TEXTS[".visited.h"] = r"""
#pragma once

#include <array>
#include <cstdint>
#include <map>
#include <optional>
#include <string>
#include <variant>
#include <vector>

struct Leaf
{
    std::int32_t x {};

    template <class Visitor>
    static void members(Visitor&& visit)
    {
        visit("x", &Leaf::x);
    }
};

enum class Hue
{
    Red = 0,
    Blue = 4,
};

struct HueMembers
{
    template <class Visitor>
    static void members(Visitor&& visit)
    {
        visit("Red", Hue::Red);
        visit("Blue", Hue::Blue);
    }
};

enum class Code
{
    low = -1,
    high = 2,
};

struct CodeMembers
{
    template <class Visitor>
    static void members(Visitor&& visit)
    {
        visit("low", Code::low);
        visit("high", Code::high);
    }
};

struct a_Same
{
    std::int64_t k {};

    template <class Visitor>
    static void members(Visitor&& visit)
    {
        visit("k", &a_Same::k);
    }
};

struct b_c_Same
{
    std::string _t {};

    template <class Visitor>
    static void members(Visitor&& visit)
    {
        visit("_t", &b_c_Same::_t);
    }
};

struct Tree
{
    std::optional<Leaf> leaf {};
    std::optional<double> om {};
    std::optional<std::optional<bool>> omo {};
    std::vector<std::string> tags {};
    std::array<std::int32_t, 2> pair {};
    std::map<std::string, Leaf> by {};
    std::string raw {};
    Hue hue {};
    Code code {};
    std::variant<a_Same, b_c_Same> u {};
    std::optional<Tree> again {};

    template <class Visitor>
    static void members(Visitor&& visit)
    {
        visit("leaf", &Tree::leaf);
        visit("om", &Tree::om);
        visit("omo", &Tree::omo);
        visit("tags", &Tree::tags);
        visit("pair", &Tree::pair);
        visit("by", &Tree::by);
        visit("raw", &Tree::raw);
        visit("hue", &Tree::hue);
        visit("code", &Tree::code);
        visit("u", &Tree::u);
        visit("again", &Tree::again);
    }
};
"""

TEXTS[".client.h"] = r"""
#pragma once

#include "forest.h"

class Client
{
public:
    virtual ~Client() = default;
    virtual Tree files_list() = 0; // files.list
    virtual void files_drop(const Leaf& request) = 0; // files.drop
    virtual void ping() = 0; // ping
};
"""

TEXTS[".ddl.sql"] = r"""
-- Leaf
struct<`x`:int>
-- a_Same
struct<`k`:bigint>
-- b_c_Same
struct<`_t`:string>
-- Tree
struct<`leaf`:struct<`x`:int>,`om`:struct<present:boolean,value:double>,`omo`:struct<present:boolean,value:boolean>,`tags`:array<string>,`pair`:array<int>,`by`:map<string,struct<`x`:int>>,`raw`:variant,`hue`:int,`code`:int,`u`:struct<tag:string,`arm_0`:struct<`k`:bigint>,`arm_1`:struct<`_t`:string>>,`again`:variant>
"""
