"""A small repository of a harbour's programs, and a change to one more file of it, used by several tests."""

from __future__ import annotations

FILES = {
    "app/clock.ts": """const PER_HOUR = 60;

/** Minutes since midnight. */
export function minutes(time: string): number {
  const [h, m] = time.split(':').map(Number);
  return h * PER_HOUR + m;
}

export class Span {
  constructor(public from: number, public to: number) {}
  get length() { return this.to - this.from; }
  static of(a: string, b: string) {
    return new Span(minutes(a), minutes(b));
  }
  overlaps(other: Span): boolean {
    return !this.empty() && other.contains(this.from);
  }
  contains(t: number): boolean {
    return t >= this.from && t < this.to;
  }
  private empty() { return this.length <= 0; }
}
""",
    "app/vessel.ts": """import type { Span } from './clock';

export interface Timetabled { slots: Span[] }

export abstract class Vessel {
  protected berth?: string;
  abstract capacity(): number;
  moor(where: string): this {
    this.berth = where;
    this.note(`moored at ${where} with ${this.capacity()} seats`);
    return this;
  }
  protected note(text: string) { console.info(text); }
}
""",
    "app/ferries/ferry.ts": """import * as clock from '../clock.js';
import { Vessel, type Timetabled } from '../vessel';
import axios from 'axios';

export type Deck = 'car' | 'foot';
export enum Class { Day, Night }

export class Ferry extends Vessel implements Timetabled {
  slots: clock.Span[] = [];
  static fleet = 0;
  constructor(readonly name: string, private decks: Deck[]) { super(); }

  capacity() {
    return this.decks.length * seatsPer('car');
  }

  depart = async (pier: string) => {
    this.moor(pier);
    await axios.post('/departures', { at: clock.minutes('10:00') });
  };
}

function seatsPer(deck: Deck): number {
  return deck === 'car' ? 40 : 200;
}
""",
    "app/ferries/index.ts": "export { Ferry as default, Class } from './ferry';\nexport * from '../clock';\nexport * as vessels from '../vessel';\n",
    "ui/board.tsx": """import Ferry, { minutes as toMinutes, Tide } from '../app/ferries';
import './board.css';

const Row = ({ ferry }: { ferry: Ferry }) => <li title="don't sail">{ferry.name}</li>;

export default function Board(props: { ferries: Ferry[] }) {
  const first = new Ferry('Ada', []);
  first.depart('north');
  return <ul data-at={toMinutes('09:30')}>it's {props.ferries.map((f) => <Row ferry={f} />)} <Row.Empty /></ul>;
}
""",
    "tools/load.cjs": """const fs = require('fs');
const { minutes, Span: Slot } = require('../app/clock');

const read = (path) => fs.readFileSync(path, 'utf8');

function load(path) {
  return read(path).split('\\n').map((l) => minutes(l));
}

module.exports = { load, slot: Slot };
exports.main = () => load(process.argv[2]);
""",
    "dist/board.js": "var b = 1;\n",
    "docs/harbour.md": "# Harbour\n",
}

PATH = "app/booking.ts"

HEAD = """import { minutes } from './clock';

type Sailing = { leaves: number; pier: string; seats: number };

const sailings = new Map<string, Sailing[]>();

export function nextFrom(pier: string, after: string): number {
  const today = sailings.get(pier) ?? [];
  const boat = today.find((s) => s.leaves > minutes(after));
  return boat.leaves;
}

export async function book(pier: string, seats: number) {
  for (const s of sailings.get(pier) ?? []) {
    if (s.seats < seats) continue;
    reserve(s, seats);
    return true;
  }
  return false;
}

async function reserve(s: Sailing, seats: number) {
  s.seats -= seats;
  await fetch(`/reserve/${s.pier}`, { method: 'POST' });
}
"""

BEFORE = HEAD.replace("return boat.leaves;", "return boat ? boat.leaves : -1;").replace("    if (s.seats < seats) continue;\n    reserve(s, seats);\n    return true;\n", "    if (s.seats >= seats) return reserve(s, seats);\n")

DIFF = """diff --git a/dist/board.js b/dist/board.js
index 51..52 100644
--- a/dist/board.js
+++ b/dist/board.js
@@ -1 +1,2 @@
 var b = 1;
+var c = 2;
diff --git a/app/booking.ts b/app/booking.ts
index 77..78 100644
--- a/app/booking.ts
+++ b/app/booking.ts
@@ -8,4 +8,4 @@ export function nextFrom(pier: string, after: string): number {
   const today = sailings.get(pier) ?? [];
   const boat = today.find((s) => s.leaves > minutes(after));
-  return boat ? boat.leaves : -1;
+  return boat.leaves;
 }
@@ -13,6 +13,8 @@ export function nextFrom(pier: string, after: string): number {
 export async function book(pier: string, seats: number) {
   for (const s of sailings.get(pier) ?? []) {
-    if (s.seats >= seats) return reserve(s, seats);
+    if (s.seats < seats) continue;
+    reserve(s, seats);
+    return true;
   }
   return false;
 }
"""


def comment(**changes) -> dict:
    return {
        "file": PATH, "line": 16, "category": "error-handling", "severity": "medium", "claim": "reserve() is not awaited, a failed booking still counts as made.",
        "evidence": "reserve(s, seats);", "suggested_fix": None, "confidence": 0.6,
    } | changes
