"""Small corpora that show every shape of evidence."""

SOURCES = {
    "shop/basket.py": '"""Baskets."""\nfrom .store import Store, find\nimport json\n\nclass Basket(Base):\n    """Holds things."""\n    def __init__(self, owner: Person):\n        self.store = Store()\n        self.fill()\n\n    def fill(self):\n        self.store.load()\n        find(1)\n        len([])\n        self.store.deep.load()\n\n    @property\n    def size(self):\n        return 1\n\n    @size.setter\n    def size(self, n):\n        check(n)\n',
    "shop/store.py": "class Base:\n    pass\n\nclass Store(Base):\n    def load(self):\n        helper()\n\ndef find(x):\n    s = Store()\n    s.load()\n    return json.dumps(x)\n\ndef helper():\n    pass\n",
    "main.zig": "const x = 1;\n",
    "bad.py": "class :\n",
}

#: A file of each other language, by language: path and source.
LANGUAGE_SOURCES = {
    "go": (
        "srv.go",
        'package main\n'
        '\n'
        'import (\n'
        '  "fmt"\n'
        '  lg "app/log"\n'
        ')\n'
        '\n'
        '// Server accepts connections.\n'
        'type Server struct {\n'
        '    Base\n'
        '    addr string\n'
        '}\n'
        '\n'
        'type Base struct { id int }\n'
        '\n'
        '// Start begins serving.\n'
        'func (s *Server) Start() error {\n'
        '    return s.listen()\n'
        '}\n'
        '\n'
        'func (s *Server) listen() error { lg.Info("x"); return nil }\n'
        '\n'
        'func main() {\n'
        '    srv := Server{addr: "a"}\n'
        '    srv.Start()\n'
        '    helper(1)\n'
        '}\n'
        '\n'
        'func helper(n int) int { return n }\n'
    ),
    "java": (
        "a/Shop.java",
        'package a;\n'
        'import java.util.List;\n'
        'import b.Store;\n'
        '/** Sells things.\n'
        ' * @author x\n'
        ' */\n'
        'public class Shop extends Base implements Open {\n'
        '  private Store store = new Store();\n'
        '  public Shop(int n) { super(n); fill(); }\n'
        '  /** Fills it. */\n'
        '  void fill() { store.load(); this.store.save(); List<String> l = null; helper(); }\n'
        '  static <T> T helper() { return null; }\n'
        '  interface Inner { void run(); }\n'
        '}\n'
    ),
    "typescript": (
        "src/app.ts",
        "import { find as f, Store } from './store';\n"
        "import * as path from 'path';\n"
        '/** An app. */\n'
        'export class App extends Base implements Runs {\n'
        '  private store: Store = new Store();\n'
        '  constructor(private log: Logger) { super(); }\n'
        '  async run(x: number): Promise<void> {\n'
        '    this.go();\n'
        '    this.store.load(`a ${x}`);\n'
        '    f(1);\n'
        '  }\n'
        '  go() { if (a) { b(); } }\n'
        '}\n'
        'export const make = (n: number) => { return new App(n); };\n'
        "function helper() { return /x{/.test('a'); }\n"
        'interface Runs { run(): void }\n'
        'type Id = string;\n'
    ),
    "javascript": (
        "lib/util.js",
        "const { load, save: put } = require('./io');\n"
        "const fs = require('fs');\n"
        '/** Parses. */\n'
        'function parse(x) { return load(x); }\n'
        'class Tree extends Node { constructor() { super(); this.root = new Node(); } add(n) { this.root.push(n); this.walk(); } walk() {} }\n'
        'Tree.prototype.size = function () { return 1; };\n'
        'module.exports = { parse };\n'
        'const go = async () => { put(); };\n'
    ),
    "csharp": (
        "Shop.cs",
        'using System;\n'
        'using L = App.Logging;\n'
        'namespace App {\n'
        '  /// <summary>Sells things.</summary>\n'
        '  public class Shop : Base, IOpen {\n'
        '    private Store store = new Store();\n'
        '    public Shop(int n) : base(n) { Fill(); }\n'
        '    public int Size { get; set; }\n'
        '    void Fill() { store.Load(); this.store.Save(); var x = new Store(); x.Load(); }\n'
        '    public static int Count() => Helper();\n'
        '    static int Helper() { return 1; }\n'
        '  }\n'
        '}\n'
    ),
    "rust": (
        "src/lib.rs",
        '//! The crate.\n'
        'use crate::store::{Store, find as look};\n'
        'mod store;\n'
        '/// A shop.\n'
        'pub struct Shop { store: Store }\n'
        'pub trait Open { fn open(&self); }\n'
        'impl Open for Shop {\n'
        '    fn open(&self) { self.fill(); }\n'
        '}\n'
        'impl Shop {\n'
        '    /// Makes one.\n'
        '    pub fn new(s: Store) -> Self { let x = Store::new(); x.load(); look(1); println!("a"); Shop { store: s } }\n'
        '    fn fill(&self) { self.store.load(); helper::<u8>(); }\n'
        '}\n'
        "fn helper<'a, T>() {}\n"
        'macro_rules! mk { () => {} }\n'
    ),
    "php": (
        "src/Shop.php",
        '<?php\n'
        'namespace App;\n'
        'use App\\Store;\n'
        'use App\\Log\\Writer as W;\n'
        '/** Sells. */\n'
        'class Shop extends Base implements Open {\n'
        '  use Loads;\n'
        '  private $store;\n'
        '  public function __construct(Store $s) { $this->store = new Store(); $this->fill(); }\n'
        '  public function fill() { $this->store->load(); helper(); W::write(); }\n'
        '}\n'
        'function helper() { return 1; }\n'
    ),
    "swift": (
        "Shop.swift",
        'import Foundation\n'
        '/// Sells.\n'
        'class Shop: Base, Open {\n'
        '    let store = Store()\n'
        '    init(n: Int) { super.init(); fill() }\n'
        '    func fill() { store.load(); self.store.save() }\n'
        '}\n'
        'extension Shop: Closed { func close() { fill() } }\n'
        'protocol Open { func open() }\n'
        'func helper(x: Store) { x.load() }\n'
    ),
    "kotlin": (
        "Shop.kt",
        'package a\n'
        'import b.Store\n'
        'import c.find as look\n'
        '/** Sells. */\n'
        'class Shop(private val store: Store) : Base(), Open by store {\n'
        '    fun fill() { store.load(); look(1); helper() }\n'
        '    fun one() = helper()\n'
        '    companion object { fun make(): Shop { return Shop(Store()) } }\n'
        '}\n'
        'fun helper(): Int { return 1 }\n'
        'fun Store.twice() { this.load() }\n'
        'object One { fun go() {} }\n'
    ),
    "c": (
        "list.c",
        '#include "list.h"\n'
        '#include <stdio.h>\n'
        '/* A list. */\n'
        'typedef struct node { int v; struct node *next; } node_t;\n'
        'struct list { node_t *head; };\n'
        'int proto(int);\n'
        '/* Adds. */\n'
        'static int add(struct list *l, int v) {\n'
        '    if (v) { push(l, v); }\n'
        '    return l->head->f(v);\n'
        '}\n'
        'void push(struct list *l, int v) { printf("x"); }\n'
    ),
    "cpp": (
        "src/shop.cpp",
        '#include "shop.hpp"\n'
        'namespace app {\n'
        '// Sells.\n'
        'class Shop : public Base, private Open {\n'
        'public:\n'
        '  Shop(int n) : Base(n), store(n) { fill(); }\n'
        '  ~Shop();\n'
        '  void fill();\n'
        '  int size() const { return store.size(); }\n'
        'private:\n'
        '  Store store;\n'
        '};\n'
        'void Shop::fill() { this->store.load(); std::move(x); helper(1); }\n'
        'int helper(int n) { return n; }\n'
        '}\n'
    ),
    "ruby": (
        "lib/shop.rb",
        "require 'json'\n"
        "require_relative 'store'\n"
        '# Sells things.\n'
        'class Shop < Base\n'
        '  include Open\n'
        '  attr_reader :name\n'
        '  def initialize(n)\n'
        '    @store = Store.new\n'
        '    fill(n) if n\n'
        '  end\n'
        '  # Fills.\n'
        '  def fill(n)\n'
        '    @store.load\n'
        '    n.each do |x|\n'
        '      self.add(x)\n'
        '    end\n'
        '    helper n\n'
        '  end\n'
        '  def self.make; Shop.new; end\n'
        '  def ok?\n'
        '    true\n'
        '  end\n'
        'end\n'
        'def helper(x)\n'
        '  x\n'
        'end\n'
    ),
    "lua": (
        "shop.lua",
        "local store = require('app.store')\n"
        'local Shop = {}\n'
        'Shop.__index = Shop\n'
        '--- Makes one.\n'
        '-- @param n\n'
        'function Shop.new(n)\n'
        '  local self = setmetatable({}, Shop)\n'
        '  return self\n'
        'end\n'
        'function Shop:fill(x)\n'
        '  if x then self:add(x) end\n'
        '  for i = 1, 2 do helper(i) end\n'
        '  store.load(x)\n'
        'end\n'
        'function Shop:add(x) end\n'
        'local function helper(i) return i end\n'
        'local go = function() helper(1) end\n'
    ),
    "bash": (
        "run.sh",
        '#!/bin/bash\n'
        'source "$DIR/lib/log.sh"\n'
        '. ./util.sh\n'
        '# Starts it.\n'
        'start() {\n'
        '  local x=${1:-a}\n'
        '  log "x" && stop\n'
        '  if check; then\n'
        '    stop | cat\n'
        '  fi\n'
        '}\n'
        'function stop {\n'
        '  echo done\n'
        '}\n'
        'start "$@"\n'
    ),
}
