"""Relations of program facts: their columns, and reading them from a folder.

Files are ``NAME.facts``: tab-separated, no header, no quoting, all columns non-null. A relation whose file is
missing is empty. Facts can be kept as Parquet, keyed by what they were read from, and extra facts of the
same names added. Schemas are always explicit; nothing is inferred.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# fixed values: the fact files of compiled object-oriented programs; :i marks a whole number
JAVA = """
Dacapo: classNameHeap method
TaintSpec: type tag id
Type-SimpleName: type simpleName
Seeds: s
StatementType: insn in_type out_type
Tamiflex: classStr methodStr mapped inClassStr inMethodStr lineNumber:i
ArrayAllocationConstSize: stmt pos:i size:i
OperatorAt: stmt op
AndroidEntryPoint: m
AndroidApplication: t
Activity: x
Service: x
ContentProvider: x
BroadcastReceiver: x
AndroidCallbackMethodName: methodName
LayoutControl: id typename parent
SensitiveLayoutControl: id typename parent
FieldInitialValue: fld valueString
AndroidId: file nodeId value prefix id
AndroidIncludeXML: file nodeId value
ArrayInitialValueFromConst: instruction index:i to arrayIndex:i const baseHeap method
ArrayInitialValueFromLocal: instruction index:i to arrayIndex:i from baseHeap method
DynamicNormalHeapAllocation: param1:i param2 param3 param4
DynamicReachableMethod: param1
DynamicContext: representation heap1rep heap2rep site1inMeth site1line:i site2inMeth site2line:i
DynamicNormalHeapObject: param1 param2 param3
DynamicStaticFieldPointsTo: param1 param2 param3
DynamicInstanceFieldPointsTo: param1 param2 param3 param4
DynamicArrayIndexPointsTo: param1 param2
DynamicCallGraphEdge: param1 param2:i param3 param4 param5
DynamicVarPointsTo: hctx heap ctx var
ClassType: class
ArrayType: arrayType
InterfaceType: interface
ComponentType: arrayType componentType
ActualParam: index:i invocation var
BootstrapParam: index:i invocation var
DirectSuperinterface: class interface
DirectSuperclass: class superclass
Field-Modifier: modifier field
ClassModifier: modifier class
FormalParam: index:i method var
Method-DeclaresException: exceptionType method
Method-Modifier: mod method
NativeReturnVar: var method
Var-Type: var type
Var-DeclaringMethod: var method
Var-SimpleName: var simplename
ApplicationClass: type
ApplicationPackage: package
ThisVar: method var
ExceptionHandler-Previous: handler previous
AssignReturnValue: invocation to
Properties: path key value
MainClass: class
Class-Artifact: artifact className subArtifact size:i
NormalHeap: id type
StringConstant: id
StringRaw: id rawId
ClassHeap: id instanceType
MethodHandleConstant: id method retType paramTypes arity:i
MethodTypeConstant: id arity:i retType paramTypes
MethodTypeConstantParam: id idx:i type
NativeLibEntryPoint: lib function addr
NativeMethodTypeCandidate: lib function descriptor offset2:i
NativeNameCandidate: lib function name offset1:i
NativeMethodId: javaMethod nativeId
NativeXRef: string lib function dataAddr:i
EmptyArray: id
ArrayAllocation: instruction pos:i sizeVar
AssignHeapAllocation: instruction index:i heap to inmethod linenumber:i
AssignLocal: instruction index:i from to inmethod
AssignBinop: instruction index:i to inmethod
AssignUnop: instruction index:i to inmethod
AssignOperFrom: instruction pos:i from
AssignOperFromConstant: instruction pos:i from
IfConstant: instruction pos:i cons
IfVar: instruction pos:i var
DummyIfVar: instruction var
AssignCast: instruction index:i from to type inmethod
AssignCastNumConstant: instruction index:i const to type inmethod
AssignCastNull: instruction index:i to type method
AssignNumConstant: instruction index:i const to inmethod
AssignNull: instruction index:i to method
AssignInstanceOf: instruction index:i from to type inmethod
Field: signature declaringClass simplename type
EnterMonitor: instruction index:i var method
ExitMonitor: instruction index:i var method
MethodInvocation-Line: instruction line:i
StaticMethodInvocation: instruction index:i signature method
SpecialMethodInvocation: instruction index:i signature base method
VirtualMethodInvocation: instruction index:i signature base method
SuperMethodInvocation: instruction index:i signature base method
DynamicMethodInvocation: instruction index:i bootSignature dynName dynRetType dynArity:i dynParamTypes tag:i method
DynamicMethodInvocation-ParamType: invocation idx:i pType
PolymorphicInvocation: invocation simpleName
Throw: instruction index:i var method
ThrowNull: instruction index:i method
ExceptionHandler: handler method index:i type begin:i end:i
ExceptionHandler-FormalParam: handler var
Method: method simplename descriptor declaringType returnType jvmDescriptor arity:i
StoreInstanceField: instruction index:i from base signature method
LoadInstanceField: instruction index:i to base signature method
StoreStaticField: instruction index:i from signature method
LoadStaticField: instruction index:i to signature method
StoreArrayIndex: instruction index:i from base method
LoadArrayIndex: instruction index:i to base method
ArrayInsnIndex: instruction index
ArrayNumIndex: instruction index:i
Goto: instruction index:i to:i method
If: instruction index:i to:i method
TableSwitch: instruction index:i key method
LookupSwitch: instruction index:i key method
TableSwitch-Target: instruction value:i target:i
LookupSwitch-Target: instruction value:i target:i
TableSwitch-Default: instruction target:i
LookupSwitch-Default: instruction target:i
Return: instruction index:i var method
ReturnVoid: instruction index:i method
AssignPhantomInvoke: instruction index:i method
BreakpointStmt: instruction index:i method
UnsupportedInstruction: instruction index:i method
Type-Annotation: type annotation
Method-Annotation: method annotation
Field-Annotation: fld annotation
Param-Annotation: method index:i annotation
AnnotationElement: annotationKind element parentId id name value1 value2
PhantomType: t
PhantomMethod: m
PhantomBasedMethod: m
NumConstantRaw: const type
XMLNode: file nodeId parentNodeId namespaceURI localName qName
XMLNodeAttribute: file nodeId index localName qName value
XMLNodeData: file nodeId data
KeepMethod: m
KeepClassMembers: m
KeepClassesWithMembers: m
KeepClass: c
RootCodeElement: id
ZipperPrecisionCriticalMethod: method
EntryPointMethod: meth
"""

# fixed values: the fact files of scripts; where a name is in both lists, this one holds for scripts
SCRIPT = """
ClassType: class
ActualPositionalParam: index:i invocation var
ActualKeywordParam: index:i invocation keyword var
DirectSuperclass: class superclass
FormalParam: index:i paramName function var
FormalParam-DefaultValueVar: function index:i var
Var-DeclaringFunction: var method
NativeReturnVar: var function
ApplicationClass: type
ThisVar: function var
ExceptionHandler-Previous: handler previous
AssignReturnValue: invocation to
NormalHeap: id type
StringConstant: id
StringRaw: id rawId
AssignHeapAllocation: instruction index:i heap to inFunction
AssignLocal: instruction index:i from to inFunction
AssignBinop: instruction index:i to oper inFunction
AssignUnop: instruction index:i to oper inFunction
AssignOperFrom: instruction operNum:i from
Import: instruction index:i name to inFunct
LexicalRead: instruction index:i to name scope inFunct
LexicalWrite: instruction index:i name scope from inFunct
GlobalRead: instruction index:i to name inFunct
GlobalWrite: instruction index:i name from inFunct
IfVar: instruction var
OriginalIntConstant: intConst
AssignIntConstant: instruction index:i const to inFunction
AssignFloatConstant: instruction index:i const to inFunction
AssignBoolConstant: instruction index:i const to inFunction
AssignNone: instruction index:i to inFunction
Instruction-SourcePosition: insn startLine:i endLine:i startColumn:i endColumn:i
Var-SourceName: var name
Field: signature declaringClass simplename
ComprehensionFunction: function
FunctionInvocation: instruction index:i to base function
FunctionInvocation-TotalParams: invocation total:i
Throw: instruction index:i var function
ExceptionHandler: handler function index:i type var begin:i end:i
ReflectiveRead: insn index:i to collection indexOrKey function
ReflectiveWrite: insn index:i collection indexOrKey from function
Function: function simplename declaringType arity:i declaredInFile
File-DeclaringPackage: file name declPackage
Package-DeclaringPackage: file name declPackage
StoreInstanceField: instruction index:i from base fieldName function
LoadInstanceField: instruction index:i to base fieldName function
Goto: instruction index:i to:i function
If: instruction index:i to:i function
Return: instruction index:i var function
ReturnNone: instruction index:i function
UnsupportedInstruction: instruction index:i function
"""


def _schemas(text: str) -> dict[str, T.StructType]:
    out = {}
    for line in text.strip().splitlines():
        name, columns = line.split(": ")
        fields = [(c.removesuffix(":i"), T.LongType() if c.endswith(":i") else T.StringType()) for c in columns.split(" ")]
        out[name] = T.StructType([T.StructField(n, t, False) for n, t in fields])
    return out


SCHEMAS = {"java": _schemas(JAVA), "script": _schemas(SCRIPT)}


def relation_name(file: str) -> str:
    return file.replace("-", "_")


def empty(spark: SparkSession, file: str, kind: str = "java") -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[kind][file])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, folder: str, file: str, kind: str = "java") -> DataFrame:
    """One relation; empty if its file is missing."""
    schema, path = SCHEMAS[kind][file], f"{folder}/{file}.facts"
    if not _exists(spark, path):
        return empty(spark, file, kind)
    df = spark.read.csv(path, sep="\t", schema=schema, quote="", header=False, mode="FAILFAST", nullValue="\0", emptyValue="")
    return df.na.fill("").distinct()


def read_inputs(spark: SparkSession, program, folder: str) -> dict[str, DataFrame]:
    """The relations that a program's ``.input`` directives name, by their declared types.

    Options: filename (default: the relation's name and ``.facts``), delimiter (default: a tab), headers ("true": a first
    line of names is passed over). A missing file is an empty relation.
    """
    from tuplewright.plans.engine import Compiler

    out, compiler = {}, Compiler(spark, program)
    for name, options in program.inputs.items():
        schema, path = compiler.schema(program.relations[name]), f"{folder}/{options.get('filename', f'{name}.facts')}"
        if not _exists(spark, path):
            out[name] = spark.createDataFrame([], schema)
            continue
        header = options.get("headers", "false") == "true"
        df = spark.read.csv(path, sep=options.get("delimiter", "\t"), schema=schema, quote="", header=header, enforceSchema=True, mode="FAILFAST", nullValue="\0", emptyValue="")
        out[name] = df.na.fill("").distinct()
    return out


def read_all(spark: SparkSession, folder: str, kind: str = "java", extra: str | None = None, only: list[str] | None = None) -> dict[str, DataFrame]:
    """Relations by name, with the facts of the same files in another folder added."""
    out = {}
    for file in only or SCHEMAS[kind]:
        df = read(spark, folder, file, kind)
        if extra:
            df = df.unionByName(read(spark, extra, file, kind)).distinct()
        out[relation_name(file)] = df
    return out


def write(df: DataFrame, folder: str, file: str) -> None:
    """Rows as a tab-separated file; tabs, line ends and quotes inside a column are escaped."""
    from pyspark.sql import functions as F

    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, '"', '\\\\"'), "\n", "\\\\\\\\n"), "\t", "\\\\\\\\t")
    rows = df.select(*(clean(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields))
    rows.write.mode("overwrite").csv(f"{folder}/{file}.facts", sep="\t", quote="", escape="", header=False, emptyValue="")


def cache_key(inputs: list[str], options: dict[str, str] | None = None) -> str:
    """A name for what a run reads: inputs in order and the options that change facts."""
    text = "\n".join([*inputs, *(f"{k}={v}" for k, v in sorted((options or {}).items()))])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def cached(spark: SparkSession, cache: str, key: str, make) -> dict[str, DataFrame]:
    """The relations kept under the key, or those that make() gives, kept as Parquet first."""
    done = f"{cache}/{key}/_DONE"
    if not _exists(spark, done):
        for name, df in make().items():
            df.write.mode("overwrite").parquet(f"{cache}/{key}/{name}")
        spark.range(1).write.mode("overwrite").parquet(done)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{cache}/{key}")
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return {n: spark.read.parquet(f"{cache}/{key}/{n}") for n in names if n != "_DONE"}
