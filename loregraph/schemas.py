"""Types of the documents that extraction makes."""

IMPORT = "struct<ord:int,spec:string,names:array<string>,default_name:string,namespace:string,type_only:boolean>"
EXPORT = "struct<ord:int,name:string,kind:string,reexport:boolean>"
STATEMENT = "struct<line:int,text:string,category:string>"
ERROR_PATH = "struct<type:string,line:int,condition:string,action:string,http_status:int>"
FUNCTION = f"struct<name:string,owner:string,signature:string,is_async:boolean,is_exported:boolean,is_default_export:boolean,start_line:int,end_line:int,code_snippet:string,calls:array<string>,key_statements:array<{STATEMENT}>,error_paths:array<{ERROR_PATH}>>"
CLASS = "struct<name:string,extends:string,implements:array<string>,methods:array<string>,properties:array<string>>"
INTERFACE = "struct<name:string,properties:array<string>>"
USAGE = "struct<symbol:string,source:string,lines:array<int>,usage:string>"
DOC = "struct<name:string,description:string,params:array<struct<name:string,type:string,description:string>>,returns:string,throws:array<string>,examples:array<string>,deprecated:string,see:array<string>>"
COMMENT = "struct<line:int,text:string,near_function:string>"
TODO = "struct<line:int,type:string,text:string>"
EXTRACTED = (
    f"path string, lines int, content_hash string, imports array<{IMPORT}>, exports array<{EXPORT}>, functions array<{FUNCTION}>, classes array<{CLASS}>, interfaces array<{INTERFACE}>, "
    f"usages array<{USAGE}>, docs array<{DOC}>, comments array<{COMMENT}>, todos array<{TODO}>, error string"
)
